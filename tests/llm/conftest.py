"""A table of awkward documents that every operator must take: nulls in any column, empty, blank and long texts, ties,
repeated rows, and extra columns whose names clash with those used inside."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, t string, fp long, key double, weight double, row long, start int, spans string, doc string, bucket int, "
          "gone_id long, several_id long, several boolean, hit_doc long, hit_text long, original string, root long, component_id long, hashes string, "
          "key_id string, key_text string, more string, base string, host string, stratum string, position long, shard int, free long, value long, part long")
CLASH = ("x", "y", 1, 1.5, 2.5, 7, 3, "z", "w", 9, 1, 2, True, 3, 4, "o", 5, 6, "h", "a", "b", "m", "c", "d", "s", 1, 2, 3, 4, 5)


def words(rng, n, pool="the of and stone river light model paper figure result table method because were with that from which into over under"):
    return " ".join(rng.choice(pool.split()) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    long = words(rng, 20_000)
    base = words(rng, 60)
    out = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " end", "en", None), (None, base, None, "b"), (None, None, None, None),
        (4, None, "en", "a"), (5, "", "en", "b"), (6, " \t\n ", "de", "b"), (7, "One", "en", "a"), (8, long, "en", "a"), (9, long + " more", "en", "b"),
        (10, "mail bob@example.com or +1 (555) 123-4567, host 10.0.0.1, card 4111 1111 1111 1111\nx", "en", "a"),
        (11, "###$$$ &&& " * 30, "en", "b"), (12, "same line here\n" * 12, "en", "b"), (13, "É" * 50 + " Ünï çødé 😀 <|endoftext|> tail", "fr", "c"),
        (13, "a different text under the same id " + words(rng, 30), "en", "c"), (14, "x" * 30_000, "en", "c")]
    return [(*r, len(r[1]) if r[1] is not None else None, *CLASH) for r in out]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
