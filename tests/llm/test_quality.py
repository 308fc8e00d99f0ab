import re
from collections import Counter

import duckdb
import pytest

from tessella.llm import quality as q

TEXTS = [
    None, "", " \n\t ", "a", "one two\nthree\none two\n\n\none two", "x " * 400, "# $ a|b <c> d é f " * 4,
    "a b c d e f g h i j k l m n o p q r s t u v w x y z", " ".join(f"w{i}" for i in range(300)) + " " + " ".join(f"w{i}" for i in range(9)),
    " ".join(f"w{i % 41}" for i in range(200)), "\n".join(["same line here with words"] * 10 + [f"other {i}" for i in range(30)]), "y" * 200_000,
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)

    def cover(k):
        seen = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        return {i + o for i in range(n - k + 1) if seen[tuple(words[i : i + k])] > 1 for o in range(k)}

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    chars = sum(map(len, words))
    failed = n < 20 or 100 * len(cover(8)) > 30 * n
    fine = len("".join(dup)) <= 0.5 * len(text) and all(sum(len(words[i]) for i in cover(k)) <= s * chars for k, s in q.Rules().grams)
    return n, chars, len(re.findall(r"[#*$%&|<>]", text)), len(dup), len(cover(8)), failed, fine and not failed


def test_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, None), (3, "a"), (None, "a b")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_words int, kept string")
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) for r in q.quality(docs).collect())
    assert got == Counter((i, *brute(t)) for i, t in rows)


def test_sql_agrees(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:-1])], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(q.SQL).fetchall()
    got = q.op8_quality_rules(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stage_keeps_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)), "en"), (2, "a " * 90, None)], "doc_id long, text string, lang string")
    out = q.stage(spark, docs, "")
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]
    assert q.quality(docs.where("false")).count() == 0


@pytest.mark.parametrize("k", [1, 5, 13])
def test_window_hashes_tell_windows_apart(k):
    from tessella.llm import common

    words = [f"w{i % 17}".encode() for i in range(200)]
    h = common.windows(common.word_hashes(words), k)
    by = {}
    for i, x in enumerate(h.tolist()):
        assert by.setdefault(x, words[i : i + k]) == words[i : i + k]
    assert len(by) == len({tuple(words[i : i + k]) for i in range(200 - k + 1)})
