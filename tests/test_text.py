import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leafwise.functions import text as t
from leafwise.functions.arrays import run_lengths
from leafwise.operators.parsing import file_extension

LETTERS = "aB Äßñ1.!?\n\t\r\x0b\x1f\x85\xa0  _'’é😀Z"
WORDS = ["BACKGROUND", "background", "Scope", "OBJECTIVES", "1. Intro", "2.1. Part", "3.1 No", "NEXT PART", "\n", " ", ". "]
texts = st.lists(
    st.lists(st.one_of(st.text(LETTERS, max_size=12), st.sampled_from(WORDS), st.just("x" * 60)), max_size=14).map("".join),
    min_size=60,
    max_size=60,
)
quick = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@quick
@given(texts)
def test_strip_equals_python(column, values):
    assert column(t.strip_ws, values) == [v.strip() for v in values]


@quick
@given(texts)
def test_headings_are_stripped_lines_in_order(column, values):
    for text, found in zip(values, column(t.extract_headings, values)):
        lines = [line.strip() for line in text.split("\n")]
        left = iter(lines)
        assert all(h in left for h in found)
        for heading in found:
            assert heading.isupper() or heading[0].isnumeric()
        assert [x for x in lines if x.isascii() and x.isalpha() and x.isupper() and len(x) > 3] == [
            x for x in found if x.isascii() and x.isalpha() and len(x) < 100
        ] or any(len(x) >= 100 for x in lines)


@quick
@given(texts)
def test_sections_start_at_a_keyword_and_hold_no_later_heading(column, values):
    for function, keywords in ((t.background, t.BACKGROUND_KEYWORDS), (t.scope, t.SCOPE_KEYWORDS)):
        whole = column(function, values)
        cut = column(lambda c: function(c, 150), values)
        for text, section, short in zip(values, whole, cut):
            if section is None:
                assert short is None
                continue
            assert any(section.lower().startswith(k) for k in keywords)
            assert section in text and section == section.strip()
            assert "\nNEXT PART\n" not in section[100:]
            assert section.startswith(short.strip())


@quick
@given(texts)
def test_sentences_cover_the_long_pieces(column, values):
    for text, found in zip(values, column(t.split_sentences, values)):
        assert all(len(s) > 20 and s == s.strip() and not set(s) & set(".!?") for s in found)
        at = 0
        for sentence in found:
            at = text.index(sentence, at) + len(sentence)


def test_heading_cases(column):
    plain = "On tides\n\t TIDES AND MOONS  \nlow water\nHARBOUR 7\nhigh water\nNeap Tide"
    dotted = "4. Moorings\n4.1. Ropes\n4.1.12. Hemp Ropes\n4.2 Chains\n5.knots"
    many = "\n".join(f"PIER {i:03}" for i in range(45))
    found = column(t.extract_headings, [plain, dotted, many, "OX\nYAK\nGNUS", ""])
    assert found[0] == ["TIDES AND MOONS", "HARBOUR 7"]
    assert found[1] == ["4. Moorings", "4.1. Ropes", "4.1.12. Hemp Ropes"]
    assert len(found[2]) == 45
    assert found[3:] == [["GNUS"], []]
    assert len(column(lambda c: t.extract_headings(c, 20), [many])[0]) == 20


def test_section_cases(column):
    both = "An introduction to boats. What is the background here?"
    assert column(t.background, [both, "boats", "backgrounded"]) == ["background here?", None, None]
    ended = "Scope\n" + "m" * 130 + "\nHARBOUR RULES\nno anchors"
    assert column(t.scope, [ended]) == ["Scope\n" + "m" * 130]
    assert len(column(t.scope, ["scope " + "m" * 7000])[0]) == 7006
    assert len(column(lambda c: t.scope(c, 900), ["scope " + "m" * 7000])[0]) == 900


def test_sentence_cases(column):
    found = column(t.split_sentences, ["Aye. The tide turns twice a day in this harbour! So?", "", "Who ties the boats up at night? The harbour master ties them up."])
    assert found == [["The tide turns twice a day in this harbour"], [], ["Who ties the boats up at night", "The harbour master ties them up"]]


def test_tokens(column):
    found = column(t.tokenize, ["Don't stop: Über 3.14, a_b!", "", "a.b.c... x’y"])
    assert found == [["don't", "stop", "über", "3.14", "a_b"], [], ["a.b.c", "x’y"]]


def test_a_token_of_many_parts_does_not_exhaust_the_stack(column):
    assert column(t.tokenize, ["a." * 20000 + "a"]) == [["a." * 20000 + "a"]]


def test_run_lengths(column):
    found = column(run_lengths, [["a", "a", "b"], [], ["z"]], "array<string>")
    assert [[tuple(r) for r in row] for row in found] == [[("a", 2), ("b", 1)], [], [("z", 1)]]


def test_extensions_and_stems(column):
    paths = ["/a/b.PDF", "/a/.hidden", "/a.b/c", "/a/x.tar.gz", "/a/..txt", "/a/n.", "doc.Docx"]
    assert column(file_extension, paths) == [".pdf", "", "", ".gz", "", ".", ".docx"]
    assert column(t.file_stem, paths[:4]) == ["b", ".hidden", "c", "x.tar"]
