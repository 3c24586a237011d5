"""Column functions: arithmetic, text, codecs, dates, number theory, draws."""
