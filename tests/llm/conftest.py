"""Fixtures of the llm operators: a small document table with every awkward row."""

import os
import random

import pytest

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer_path(name):
    return str(pytest.importorskip("public_tokenizers").path(name))


@pytest.fixture(scope="session")
def pieces():
    return tokenizer_path(PIECES)


@pytest.fixture(scope="session")
def words_file():
    return tokenizer_path(WORDS)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, label int, row int"


def sentence(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


def make_docs():
    """Nulls in every column, empty and blank texts, one very long text, repeated rows, exact and near copies, shared
    passages; extra columns carry names that the operators use themselves."""
    rng = random.Random(7)
    en = [a + b for a in ("th", "an", "re", "wo", "st", "li", "co", "pr") for b in ("e", "ing", "ed", "ly", "er", "on", "ment", "est")]
    de = [a + b for a in ("sch", "ver", "ge", "ein", "un", "zw", "pf", "kr") for b in ("ung", "keit", "lich", "ß", "ö", "isch", "heit", "en")]
    passage = "\n".join(sentence(rng, 20, en) for _ in range(4))
    rows, texts = [], []
    for i in range(60):
        stock, lang = (en, "en") if i % 3 else (de, "de")
        body = "\n".join(sentence(rng, rng.randint(4, 30), stock) for _ in range(rng.randint(3, 9)))
        if i % 7 == 0:
            body += "\n" + passage + "\n" + sentence(rng, 9, stock)
        texts.append(body)
        rows.append((i, body, lang, f"s{i % 4}"))
    for i in range(60, 70):  # near copies of text 5
        w = texts[5].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "s0"))
    rows += [(i, texts[8], "en", "s1") for i in range(70, 74)]  # exact copies
    rows += [(74, None, "en", "s0"), (75, "", "de", None), (76, " \n\t ", None, "s1"), (77, "one", "en", "s2"), (78, "1234 !!", "en", "s2")]
    rows += [(None, texts[9], "en", "s0"), (None, None, None, None), (79, texts[10], "en", "s2"), (79, texts[10], "en", "s2")]
    rows += [(80, "\n".join(sentence(rng, 25, en) for _ in range(1500)), "en", "s3")]
    rows += [(81, "Released under the MIT License.\nThis is mit license mit license and Apache  License, Version 2.0", "en", "s3"),
             (82, "licensed under CC BY-NC 4.0. İK ÀÉ mi̇t license general public\nlicense <|endoftext|> a|b #", "en", "s3")]
    rows += [(83, "word " * 200, "en", "s3"), (84, "a b c " * 3 + "#$%& <|> x y z", "en", "s3"), (85, "日本語 テスト   spaces\x00\x1f ", None, "s3")]
    return [(d, t, lang, s, None if t is None else len(t), "x", None, 1, 2) for d, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
