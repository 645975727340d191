import subprocess
import sys
import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
import test_decontamination as brute_decontamination
import test_line_dedup as brute_line_dedup
import test_simhash as brute_simhash
from tickerloom.llm import decontamination, packing, quality_classifier, simhash
from tickerloom.llm.common import _made, stored


def test_stages_keep_the_columns(spark, documents, data):
    docs, counts = documents, [documents.count()]
    for name, stage in P.STAGES:
        out = stored(stage(spark, docs, data), name.replace(" ", "-"))
        if name != "packing":
            assert out.columns == documents.columns
            counts.append(out.count())
            before = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert {r["doc_id"] for r in out.select("doc_id").collect()} <= before
        if name == "line dedup":
            assert out.where("n_chars <> length(text)").count() == 0
        if name == "simhash near-dedup":
            groups = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id")
            assert out.select("doc_id").exceptAll(groups).count() == groups.exceptAll(out.select("doc_id")).count() == 0
        if name == "benchmark decontamination":
            bench = spark.read.parquet(f"{data}/benchmark.parquet")
            assert decontamination.find_overlaps(out, bench).count() == 0
        if name == "packing":
            assert out.select("doc_id").distinct().count() == counts[-1]
        else:
            docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stage_takes_odd_rows(spark, odd, none, data, name):
    stage = dict(P.STAGES)[name]
    out = stage(spark, odd, data)
    if name != "packing":
        assert out.columns == odd.columns
    assert out.count() > 0 and stage(spark, none, data).count() == 0


def test_run(spark, data):
    assert set(P.run(spark, data).columns) == {"doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"}


def test_run_equals_brute_force(spark, tmp_path, documents, texts, data):
    """Documents and their ids after all stages, each stage by plain means."""
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.orderBy("item_id").limit(8).collect()}
    short = [d for d in sorted(texts) if texts[d] and len(texts[d]) < 1200][:60]
    made = {d: texts[d] for d in short}
    a, b, c = short[:3]
    made[9001] = texts[a] + "\n" + texts[b]  # both halves repeat lines
    made[9002] = texts[c].replace(" ", " so ", 1)
    made[9003] = "before it. " + items[min(items)] + " after it, " + " ".join(f"w{k}" for k in range(40))
    made[9004] = made[9005] = "\n".join(f"unheard line {k} of its very own kind {k * 7} here" for k in range(9))
    made[9006] = ""
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in made.items()], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    bench.where(bench["item_id"].isin(list(items))).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    given = sorted({(r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] in made and r["quality"] is not None})
    taught = [(d, q) for d, q in given if zlib.crc32(str(d).encode()) % 5 and sum(x == d for x, _ in given) == 1]
    model = quality_classifier.fit([made[d].encode() for d, _ in taught], [q for _, q in taught])
    size = len(model.table) // 3

    def odds(text):
        where, weight = quality_classifier.sparse(text.encode(), size.bit_length() - 1)
        return model.bias + float((model.table[where].astype(float) * weight).sum())

    left = {d: t for d, t in made.items() if 1 / (1 + np.exp(-odds(t))) >= P.QUALITY_FROM}
    left = {d: v[0] for d, v in brute_line_dedup.brute(left).items() if v[1] == 0 or v[2] + v[3] < v[1]}
    label = brute_simhash.brute_components({d: brute_simhash.brute_print(t) for d, t in left.items()})
    left = {d: t for d, t in left.items() if label[d] == d}
    hit = {d for d, _ in brute_decontamination.brute_pairs(left, items)}
    assert hit and len(left) < len(made)
    left = {d: t for d, t in left.items() if d not in hit}

    before = len(_made)
    pieces = P.run(spark, str(tmp_path)).collect()
    assert len(_made) == before + 1  # nothing is left but the result
    got = {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert got == {d: np.array([*library.encode(t, add_special_tokens=False).ids, packing.END_ID], "<u4").tobytes() for d, t in left.items()}


#: In a session of its own with one worker, so that all tasks run in the same process.
HELD = """
import pyarrow as pa
from pyspark.sql import SparkSession
from tickerloom.llm.texts import with_columns

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
one = spark.createDataFrame([("a",)] * 50, "text string").repartition(1)

def grown(texts):
    kept = [bytes(1000 + k % 7) for k in range(60_000)]
    return {"size": [pa.array([b"x" * 1000] * 30_000).nbytes + len(kept)] * len(texts)}

def held(texts):
    with open("/proc/self/smaps_rollup") as f:
        mb = next(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) // 1024
    return {"mb": [mb] * len(texts)}

def now():
    return with_columns(one, held, "mb long", keep=[]).first()[0]

before = now()
for _ in range(4):
    with_columns(one, grown, "size long", keep=[]).collect()
print("HELD", before, now())
"""


def test_workers_hand_memory_back():
    """After a task a worker holds little more than before it, whatever its batches took."""
    said = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, timeout=120, check=True).stdout
    before, after = map(int, said.split("HELD")[1].split())
    assert after < before + 40, (before, after)
