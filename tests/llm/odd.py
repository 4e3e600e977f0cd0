"""Documents of every awkward kind, with columns whose names the operators use themselves."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, node string, lang_pred string, n_links int, kept boolean, _key string"
PROSE = " ".join(f"word{n % 97} and{n % 13} other{n % 31}" for n in range(400))
LONG = "\n".join(f"line {n} of a very long text with several words" for n in range(20_000))
TEXTS = [
    None, "", " \t\n ", "x", "one two three four", PROSE, PROSE, PROSE.replace("word5 ", "changed "), LONG, "z" * 300_000, "12345 67890", "Ünïcödé ñandú 日本語 🎉 é",
    "a@b.co +1 (555) 555-0100 4111 1111 1111 1111 10.0.0.1", "\n\n\n", "same line\nsame line\nother", "<|endoftext|> 'S don't", "0" * 5000 + ".1.1.1",
]


def rows(texts=TEXTS) -> list[tuple]:
    out = [(n, t, ("en", "fr", None)[n % 3], f"src{n}", None if t is None else len(t), 0.5, "k", "n", "xx", 7, True, "q") for n, t in enumerate(texts)]
    first = out[5]
    return [*out, first, first, (None, *first[1:]), (None, None, *[None] * 10)]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(rows(texts), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def balanced_words(n: int) -> list[str]:
    """Pairs of words of n letters that differ everywhere, yet have equal sums of any polynomial in the letters."""
    side = [bin(k).count("1") & 1 for k in range(n)]
    return [w for a, b in ("ab", "qz", "in", "th", "1x") for w in ("".join((a, b)[k] for k in side), "".join((b, a)[k] for k in side))]
