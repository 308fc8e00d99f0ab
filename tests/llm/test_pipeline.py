import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import common, quality, secrets

from .test_jaccard import brute as components
from .test_substring import brute as cut


def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 7)))
    passage = [word() for _ in range(50)]
    texts = [None, "", "too short", "bad " * 100, " ".join(passage)]
    for k in range(60):
        own = [word() for _ in range(rnd.randint(25, 140))]
        if k % 5 == 0:
            own[5:5] = passage
        if k % 7 == 0:
            own[9:9] = ["password=abcdef123456"]
        texts.append(" ".join(own))
        if k % 6 == 0:
            texts += [" ".join(own), " ".join([*own, word()])]
    return list(enumerate(texts)) + [(3, "too short"), (None, texts[20] + " more")]


def brute(rows):
    rules = quality.Rules()
    rows = [(i, t) for i, t in rows if quality.verdict(quality.measure((t or "").encode(), rules), rules)[1]]
    kept = {c for _, _, c in components(rows)}
    rows = [(i, t) for i, t in rows if i in kept]
    words = cut([t for _, t in rows], 35)
    rows = [(i, w[2].decode() if w[1] else t) for (i, t), w in zip(rows, words, strict=True)]
    return [(i, secrets.redact(t, sum(secrets.scan(t), []))) for i, t in rows]


def test_stages_equal_brute_force(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    docs = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, ""))
        assert docs.columns == columns, name
    want = brute(rows)
    assert Counter((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == Counter((i, t, len(t)) for i, t in want)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in want}
    held = defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect():
        assert r.doc_tokens == tokens[r.doc_id]
        held[r.doc_id] += r.length
    assert dict(held) == tokens


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "", "", 0), (1, "", "", "", 0)]])
def test_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
