import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _n string, th string, node string, block long, source_size double, doc_tokens string"


def _prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def make_rows():
    """Documents with copies, near copies, shared passages, nulls, empties, repeats."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    passage = _prose(rng, 90, words)
    texts = [_prose(rng, rng.randint(5, 400), words) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7].upper(), texts[9] + " tail", "x " + texts[9]]
    edited = texts[12].split()
    for k in range(6):
        e = list(edited)
        e[(k * 17) % len(e)] = "edit%d" % k
        texts.append(" ".join(e))
    texts += [_prose(rng, 30, words) + "\n" + passage + "\n" + _prose(rng, 20, words) for _ in range(8)]
    texts += [passage * 3, "a" * 2000, "ab" * 700, "", " \t\n", "one", "one two", "Two One", None, "<|endoftext|> x's 12 ☃", "line one\nline one\nline two"]
    texts += [_prose(rng, 12_000, words)]
    rows = []
    for k, t in enumerate(texts):
        source = None if k % 11 == 0 else "hot" if k % 3 else f"s{k % 4}"
        rows.append((None if k in (20, 21) else k, t, None if k % 5 == 0 else "en", source, None if t is None else len(t), "extra", "t", None, 1, 2.5, None))
    rows.append(rows[5])
    rows.append(rows[3])
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(tmp_path):
    """Write tables as an input folder and give its path."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
