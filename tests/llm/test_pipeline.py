"""The whole pipeline on a small corpus, against a plain reading of each stage's contract."""

import re
import zlib

import numpy as np
import pytest

pytest.importorskip("sparkrelief.llm")
import corpus_pipeline  # noqa: E402
from sparkrelief.llm import bpe  # noqa: E402

WORDS = {"en": "the river house green walk under morning light never always people water", "de": "der fluss haus wald gehen unter morgen licht niemals immer leute wasser"}


def _corpus():
    rng = np.random.default_rng(11)
    sentence = lambda x, n: " ".join(rng.choice(WORDS[x].split(), n))
    rows = [(i, sentence(("en", "de")[i % 2], 60), ("en", "de")[i % 2], "s") for i in range(60)]
    rows += [(100, rows[3][1], "de", "s"), (101, rows[3][1] + " ende", "de", "s")]  # copies of 3
    passage = sentence("en", 25)
    rows += [(110, "first " + passage + " " + sentence("en", 40), "en", "s"), (111, sentence("en", 40) + " " + passage, "en", "s")]
    rows += [(120, sentence("en", 30) + " write to jane.doe@example.org or 10.1.2.3 now", "en", "s")]
    rows += [(130, None, "en", "s"), (131, "", "en", "s"), (132, "12345 !!", "en", "s"), (133, sentence("en", 9000), "en", "s"), (None, sentence("de", 20), "de", "s")]
    return rows, passage


def test_pipeline_end_to_end(spark, tmp_path):
    rows, passage = _corpus()
    full = [(d, t, x, s, len(t or ""), "clash", 0.5) for d, t, x, s in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
        if k < 4:
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            assert all(r.spans == "clash" and r.score == 0.5 and r.source == "s" for r in kept[name])
    ids = {name: [r.doc_id for r in r_] for name, r_ in kept.items()}
    assert not {130, 131, 132} & set(ids["language_id"]) and {0, 1, 100, 133, None} <= set(ids["language_id"])
    assert set(ids["language_id"]) - set(ids["minhash_near_dedup"]) == {100, 101}
    cut = {r.doc_id: r for r in kept["suffix_array_dedup"]}
    assert set(cut) == set(ids["minhash_near_dedup"]) and passage in cut[110].text and passage not in cut[111].text
    before = {r.doc_id: r.text for r in kept["minhash_near_dedup"]}
    assert all(len(r.text) == r.n_chars for r in cut.values()) and cut[120].text == before[120]
    clean = {r.doc_id: r.text for r in kept["pii"]}
    assert "<email>" in clean[120] and "<ip>" in clean[120] and "jane" not in clean[120]
    assert {d: t for d, t in clean.items() if d != 120} == {d: r.text for d, r in cut.items() if d != 120}
    lib = bpe.loaded(bpe.default_path()).library
    want = []
    for d, t in clean.items():
        x = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want += [(d, k // 4096, k, len(x[k : k + 4096]), zlib.crc32(np.array(x[k : k + 4096], "<u4").tobytes())) for k in range(0, len(x), 4096)]
    packed = kept["best_fit_packing"]
    key = lambda r: str(r)
    assert sorted((tuple(r)[:5] for r in packed), key=key) == sorted(want, key=key)
    seqs: dict[int, list] = {}
    for r in packed:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((tuple(r)[:5] for r in whole.collect()), key=key) == sorted(want, key=key)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "pii", "best_fit_packing"] and re.fullmatch("None|str", str(corpus_pipeline.ORACLE_SQL))
