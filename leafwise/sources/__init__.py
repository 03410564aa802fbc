"""Where documents come from and where tables and exports go."""
