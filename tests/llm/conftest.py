import random

import pytest

LETTERS = {"en": ["the", "and", "thing", "ouning", "erth", "hand", "ing", "thon"], "de": ["der", "und", "schein", "ungkeit", "lich", "ver"],
           "fr": ["le", "que", "ément", "oueau", "tion", "dans"]}


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents-like table from (doc_id, text, lang) rows plus columns whose names clash with what operators add."""
    def build(rows):
        data = [(i, t, lang, "src", len(t) if t is not None else None, 1.5, "x", 7, "c") for i, t, lang in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, "
                                           "fingerprint string, part int, contamination string")
    return build


@pytest.fixture(scope="session")
def write_tables(spark, tmp_path_factory):
    """A folder of tables like the test data's, from DataFrames."""
    def build(**tables):
        root = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{root}/{name}.parquet")
        return str(root)
    return build


def prose(rng: random.Random, words: int, lang: str = "en") -> str:
    return " ".join(rng.choice(LETTERS[lang]) + rng.choice(LETTERS[lang]) for _ in range(words))


#: Texts that every operator must survive.
ODD_TEXTS = [None, "", " ", "\n\t ", "a", "!!!", "é", "日本語 テキスト", "a" * 30_000, "word " * 20_000, "1" * 5_000, "▁ ▁▁x", "\x00\x01", "İstanbul ﬁ"]
