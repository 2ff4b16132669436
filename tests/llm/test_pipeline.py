"""The pipeline against plain versions of its stages, on what odd documents and a small benchmark make of it."""

import hashlib
import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ragmill.llm import common, quality

from . import brute
from .conftest import make, sentence
from .test_texts import junk_rows

ITEM = "zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def rows():
    rng = random.Random(9)
    out = [r for r in junk_rows() if r[0] != 37]
    out += [(300 + k, sentence(rng, 40) + "\n" + ITEM.upper() + "\n" + sentence(rng, 30)) for k in range(2)]
    return out


def test_pipeline(spark, tmp_path):
    make(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, ITEM), (1, sentence(random.Random(1), 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    good = {r.doc_id for r in quality.judge(common.read(spark, str(tmp_path), "documents")).where("kept").collect()}
    docs = [(d, t) for d, t in rows() if d in good]
    docs = [(d, t) for d, _, t in brute.line_dedup(docs)]
    docs = [(d, t) for d, t in docs if d is None or dict((x[0], x[2]) for x in brute.components(docs))[d] == d]
    leaks = {d for d, *_ in brute.contained(docs, [(0, ITEM)])}
    docs = {d: t for d, t in docs if d not in leaks}
    assert leaks and set(found) == set(docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, t in docs.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        data = struct.pack(f"<{len(ids)}I", *ids)
        assert (found[d].n_tokens, bytes(found[d].ids), found[d].ids_sha256) == (len(ids), data, hashlib.sha256(data).hexdigest())


def test_stages_keep_the_columns(spark, tmp_path):
    make(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = common.read(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
