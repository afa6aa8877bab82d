"""The pipeline's stages and its whole against brute force, on whole given tables."""

import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from storyspark.llm import packing
from storyspark.llm.encoder import default_path
from storyspark.llm.queries import ORACLES, QUERIES, _mix_sql

from test_native import base_spans
from test_pairs import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def sql(query, documents):
    """Rows of a query whose ``documents`` are the given ones."""
    c = duckdb.connect()
    c.sql("SET temp_directory = ''")
    c.register("documents", documents)
    return c.sql(query).fetchall()


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_every_query_is_registered():
    names = {int(m[1]) for q in entry.queries() if (m := re.match(r"op(\d+)_", q))}
    assert names == set(range(1, 14)) and "pipeline" in entry.queries() and len(QUERIES) == 13
    assert set(ORACLES) == {"op1_license_scan", "op4_quality_rules", "op6_topk_search", "op10_mixing", "op11_hard_negatives", "op13_prefix_trie"}


def test_stages_do_the_whole_job(stages):
    docs, ruled, single, masked, mixed, packed = stages
    assert all(s.columns == COLUMNS for s in stages[:-1])
    given = docs.toPandas()
    verdict = ORACLES["op4_quality_rules"]
    want = {r[0] for r in sql(f"SELECT doc_id FROM ({verdict}) WHERE kept", given)}
    assert set(rows(ruled)) == want and 0 < len(want) < len(given)

    of = brute([(i, r["text"]) for i, r in rows(ruled).items()], 5)
    assert set(rows(single)) == {i for i, root in of.items() if i == root}

    before, after = rows(single), rows(masked)
    assert set(before) == set(after)
    for i, r in before.items():
        kinds = re.findall(r"\[(EMAIL|IP|CARD|PHONE)\]", after[i]["text"])
        assert len(kinds) == len(base_spans(r["text"])) and not base_spans(after[i]["text"])
        assert after[i]["n_chars"] == (len(after[i]["text"]) if after[i]["text"] != r["text"] else r["n_chars"])

    want = {r[0] for r in sql(f"SELECT doc_id FROM ({_mix_sql(pipeline.MIX)})", masked.toPandas())}
    assert set(rows(mixed)) == want and len(want) < len(after)

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    pieces = set()
    for i, r in rows(mixed).items():
        own = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        pieces |= {(i, p, a, b - a, zlib.crc32(own[a:b].tobytes())) for p, (a, b) in enumerate(packing.cut(len(own), 1024))}
    got = packed.collect()
    assert {tuple(r[:5]) for r in got} == pieces and len(got) == len(pieces)
    assert len({r["sequence_id"] for r in got}) <= 1.05 * -(-sum(r["length"] for r in got) // 1024)


def test_run_is_the_stages_one_after_the_other(spark, stages):
    key = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    assert key(pipeline.run(spark, SF)) == key(stages[-1])


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, odd, empty, k):
    _, stage = pipeline.STAGES[k]
    for df in (odd, empty):
        out = stage(spark, df, SF)
        if k < 4:
            assert out.columns == df.columns
        assert out.count() <= max(12, df.count()) * 40


def test_stages_leave_clashing_columns_alone(spark):
    text = " ".join(f"word{k}" for k in range(80))
    extra = "spans string, tokens string, domain string, epoch string, _i int, _c string, _leaf string, _row string, _key int, _base int, m map<string,int>, n_chars long"
    rows = [(k, f"{text} {k % 7} mail a{k}@b.example.org" if k % 2 else f"{text} other{k % 5} " * 2, "en", "src1", "s", "t", "d", "e", k, "c", "l", "r", 1, 2, {"a": k}, 5)
            for k in range(40)] + [(3, "again " + text, "en", "src2", *["z"] * 4, 9, *["z"] * 3, 1, 2, {"b": 1}, 7)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}")
    names = [c for c in df.columns if c not in ("text", "n_chars")]
    known = {str([r[c] for c in names]) for r in df.collect()}
    for name, stage in pipeline.STAGES[:4]:
        got = stage(spark, df, SF)
        assert got.schema.simpleString() == df.schema.simpleString(), name
        found = got.collect()
        assert found and {str([r[c] for c in names]) for r in found} <= known, name
        if name == "pii":
            assert len(found) == 41 and all(("[EMAIL]" in r["text"]) == (r["doc_id"] % 2 == 1 and "again" not in r["text"]) for r in found)
        if name == "near_dedup":
            assert len({r["doc_id"] for r in found}) == len(found) < 20


def test_nothing_else_imports_the_subpackage():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(f"{top}/storyspark"):
        if not folder.endswith("llm"):
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"(from|import) .*\bllm\b", open(f"{folder}/{n}").read()), n
