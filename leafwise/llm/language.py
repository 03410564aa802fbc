"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of three letters in a row
is the product of their vectors, the first shifted by two places and the second by
one, so that order counts. A text's vector bundles (adds) those of its n-grams; a
language's prototype bundles the unit vectors of its labelled documents. A text gets
the language whose prototype lies at the least angle.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.llm.words import U64, mix, released

#: Length of the vectors.
DIMENSIONS = 1024
#: Letter vectors; code points beyond share them by their remainder.
LETTERS = 4096
UNKNOWN = "und"
#: Texts are cut into pieces of so many characters before their n-grams are counted.
PIECE = 1 << 20
#: Cosines of unrelated vectors lie within so many of their standard deviations.
CHANCE = 3
#: Texts of a length class tell a language if their median cosine is so many times that bound, in so many learned texts.
CLEAR, LEAST_LEARNED = 4, 100


def letter_vectors(dimensions: int) -> np.ndarray:
    """A fixed random +1/-1 vector for each letter; the space between words has its own."""
    bits = mix(np.arange(LETTERS * dimensions // 64, dtype=U64) + U64(11))
    signs = np.unpackbits(bits.view(np.uint8)).reshape(LETTERS, dimensions)
    return signs.astype(np.int8) * 2 - 1


class Encoder:
    """Vectors of texts. One per task: its tables are made once."""

    def __init__(self, dimensions: int = DIMENSIONS):
        third = letter_vectors(dimensions)
        self.tables = np.roll(third, 2, axis=1), np.roll(third, 1, axis=1), third
        self.letter = np.zeros(sys.maxunicode + 1, dtype=bool)
        self.letter[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = True

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the text's letter triples and how often each occurs.

        Letters are lower-cased, anything else between them is one space, and a space
        stands at both ends; triples with a space in the middle tell nothing.
        """
        codes, counts = [], []
        tail = np.zeros(1, dtype=np.int64)
        for begin in range(0, len(text), PIECE):
            points = np.frombuffer(text[begin : begin + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
            letters = np.where(self.letter[points], 1 + points % (LETTERS - 1), 0).astype(np.int64)
            own = np.concatenate((tail, letters, [0] * (begin + PIECE >= len(text))))
            keep = np.ones(len(own), dtype=bool)
            keep[1:] = (own[1:] != 0) | (own[:-1] != 0)
            own = own[keep]
            code = (own[:-2] * LETTERS + own[1:-1]) * LETTERS + own[2:]
            code, n = np.unique(code[own[1:-1] != 0], return_counts=True)
            codes.append(code)
            counts.append(n)
            tail = own[-2:]
        if len(codes) == 1:
            return codes[0], counts[0]
        if not codes:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        code, back = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(back, np.concatenate(counts)).astype(np.int64)

    def vector(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a text; none without letters."""
        return self.bundle(*self.grams(text or ""))

    def bundle(self, code: np.ndarray, n: np.ndarray) -> np.ndarray | None:
        """The unit vector of letter triples."""
        if not len(code):
            return None
        total = np.zeros(self.tables[2].shape[1], dtype=np.float32)
        for a in range(0, len(code), 4096):
            c = code[a : a + 4096]
            one, two, three = c // LETTERS**2, c // LETTERS % LETTERS, c % LETTERS
            bound = self.tables[0][one] * self.tables[1][two] * self.tables[2][three]
            total += n[a : a + 4096].astype(np.float32) @ bound.astype(np.float32)
        length = np.linalg.norm(total)
        return total / length if length else None


def prototypes(documents: DataFrame, dimensions: int = DIMENSIONS, text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """``label, place, value``: the sum of the vectors of each label's documents.

    Each task adds up its own, so that a label with most of the rows is no one's burden.
    """

    def add(batches):
        encoder, sums = Encoder(dimensions), {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vector = encoder.vector(text)
                if vector is not None:
                    total = sums.setdefault(label, np.zeros(dimensions))
                    total += vector
        for label, total in sums.items():
            columns = [pa.array([label] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["label", "place", "value"])

    labelled = documents.select(F.col(f"`{label_column}`").alias("label"), F.col(f"`{text_column}`").alias("text")).dropna()
    sums = labelled.mapInArrow(released(add), "label string, place int, value double")
    return sums.groupBy("label", "place").agg(F.sum("value").alias("value"))


def nearest(documents: DataFrame, profile: DataFrame, dimensions: int = DIMENSIONS, text_column: str = "text", unknown: str = UNKNOWN) -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` and ``n_triples``, the text's count of letter triples.

    The profile holds one vector per language and is read to the driver: its size is
    that of the languages. Ties go to the label that sorts first. Without any learned
    language every text is ``unknown``.
    """
    rows = profile.collect()
    names = sorted({r["label"] for r in rows})
    table = np.zeros((len(names), dimensions), dtype=np.float32)
    at = {name: i for i, name in enumerate(names)}
    for r in rows:
        table[at[r["label"]], r["place"]] = r["value"]
    lengths = np.linalg.norm(table, axis=1, keepdims=True)
    table /= np.where(lengths, lengths, 1)
    kept = documents.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)

    def compare(batches):
        encoder = Encoder(dimensions)
        for batch in batches:
            found, scores, triples = [], [], []
            for text in batch.column(text_column).to_pylist():
                code, n = encoder.grams(text or "")
                triples.append(int(n.sum()))
                vector = encoder.bundle(code, n) if names else None
                if vector is None:
                    found.append(unknown)
                    scores.append(0.0)
                else:
                    cosine = table @ vector
                    best = int(cosine.argmax())
                    found.append(names[best])
                    scores.append(float(min(max(cosine[best], 0.0), 1.0)))
            columns = [*(batch.column(c) for c in kept), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(triples, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score", "n_triples"])

    return documents.mapInArrow(released(compare), f"{schema}, lang_pred string, score double, n_triples long")


def chance(dimensions: int = DIMENSIONS) -> float:
    """The cosine that a text unlike all learned ones may have with a prototype."""
    return CHANCE / dimensions**0.5


def least_triples(judged: DataFrame, dimensions: int = DIMENSIONS) -> int | None:
    """Letter triples from which on a cosine within ``chance`` means that a text is in no learned language.

    Learned from ``judged``, the labelled texts as ``nearest`` returns them. Texts of a
    few words lie near chance even if they are clean, so their cosine decides nothing.
    Of the lengths between powers of two, the shortest counts whose texts stand clear
    of chance. None if no length has texts enough.
    """
    size = F.floor(F.log2("n_triples")).alias("size")
    each = judged.filter("n_triples > 0").groupBy(size).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", 0.5).alias("middle"))
    clear = [r["size"] for r in each.collect() if r["n"] >= LEAST_LEARNED and r["middle"] >= CLEAR * chance(dimensions)]
    return 2 ** min(clear) if clear else None


def identify_languages(
    documents: DataFrame,
    training=None,
    dimensions: int = DIMENSIONS,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``documents``.

    ``training``: a condition on the documents; those that meet it and have a label
    are learned from (all by default), the others are ``held_out``. A condition that
    is null holds out. ``score`` is the cosine with the prototype. A text that is null
    or has no letter is ``und`` with score 0. Rows that repeat are judged alike; an
    empty table gives no rows. Other columns are left out.
    """
    training = F.lit(True) if training is None else training
    learned = F.coalesce(training, F.lit(False))
    profile = prototypes(documents.filter(learned), dimensions, text_column, label_column)
    chosen = documents.select(F.col(f"`{id_column}`").alias("doc_id"), (~learned).alias("held_out"), F.col(f"`{text_column}`").alias("text"))
    return nearest(chosen, profile, dimensions).drop("text", "n_triples")
