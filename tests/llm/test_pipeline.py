"""The pipeline stage by stage on the smallest table."""

import glob
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vectide.llm import line_dedup, mixing, packing, secret_scan, similar, simhash, suffix_dedup
from vectide.llm.common import BATCH_BYTES, bound_batches, numbered, shared_dir


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == columns, name
        a, b = ({r.doc_id for r in x.collect()} for x in (before, after))
        assert b <= a, name
        if name in ("secret_scan", "source_mixing"):
            assert a == b
        if name == "secret_scan":
            assert before.where("text like '%AKIA%'").count() == 0 or after.where("text like '%[SECRET]%'").count() > 0
            again = secret_scan.scan(after).selectExpr("size(filter(secret_spans, x -> x.k < 3)) as n").where("n > 0").count()
            assert again == 0
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in before.collect()}
    fill = Counter()
    for r in last:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.CONTEXT


def made(spark):
    return glob.glob(shared_dir(spark).removeprefix("file:") + "/vectide-*")


def test_run(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "source_mixing", "best_fit_packing"]
    before = set(made(spark))
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = [p.split("/vectide-")[1].rsplit("-", 1)[0] for p in set(made(spark)) - before]
    assert left == ["best_fit_packing"]  # intermediate tables are gone


def test_near_copies_with_edited_words_go(spark, sf):
    """Similarity 0.9 to 0.95 of 5-word shingles, which few SimHashes within two bits have."""
    r, rows = random.Random(4), []
    for k in range(20):
        words = [f"w{r.randint(0, 10**5)}" for _ in range(400)]
        rows.append((10 * k, " ".join(words)))
        for j in range(1, 3):
            copy = list(words)
            for i in r.sample(range(400), 2 * j):
                copy[i] = f"edit{r.randint(0, 10**9)}"
            rows.append((10 * k + j, " ".join(copy)))
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(x.doc_id for x in kept.collect()) == [10 * k for k in range(20)]


def test_sequences_follow_the_mix(spark, sf, monkeypatch):
    """The documents in the first so many windows of sequences hold the target weights to less than a block."""
    monkeypatch.setattr(packing, "WINDOW", 64)
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["stone", "river", "lantern", "quiet"]) for _ in range(r.choice([5, 90, 400, 2500]))), "hot" if i % 4 else f"s{i % 12}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    source, sizes = {d: s for d, _, s in rows}, Counter(s for _, _, s in rows)
    total = sum(n**0.5 for n in sizes.values())
    packed = corpus_pipeline.pack(spark, corpus_pipeline.mix_sources(spark, docs, sf), sf).collect()
    by, seen, checked = {}, set(), 0
    for x in packed:
        by.setdefault(x.sequence_id, []).append(x)
    ids = sorted(by)
    for n, i in enumerate(ids):
        seen |= {x.doc_id for x in by[i]}
        places = sorted((x.offset, x.length) for x in by[i])
        assert [o for o, _ in places] == [sum(k for _, k in places[:j]) for j in range(len(places))] and sum(k for _, k in places) <= packing.CONTEXT
        if len(seen) % 64 == 0 and len(seen) <= 384 and (n + 1 == len(ids) or not seen & {x.doc_id for x in by[ids[n + 1]]}):
            have, checked = Counter(source[d] for d in seen), checked + 1
            assert all(abs(have[s] - k**0.5 / total * len(seen)) < 16 + 1e-9 for s, k in sizes.items())
    assert checked >= 6 and seen == set(source)
    plain = packing.pack_documents(docs).selectExpr("doc_id", "piece", "start", "length", "crc32(ids) as c").collect()
    assert Counter(map(tuple, plain)) == Counter((x.doc_id, x.piece, x.start, x.length, zlib.crc32(x.ids)) for x in packed)


@pytest.mark.parametrize("written", [True, False])
def test_packing_takes_the_order_that_mixing_made(spark, tmp_path, monkeypatch, written):
    """Also with weights that are not the default; files are written of unlike size, which a scan doesn't read in their order."""
    monkeypatch.setattr(packing, "WINDOW", 64)
    rows = [(i, "stone " * (1 + i % 7 * 60), "hot" if i % 4 else "cold") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixed = mixing.in_order(docs, weights={"hot": 1, "cold": 3})
    if written:
        mixed.write.parquet(f"{tmp_path}/mixed")
        mixed = spark.read.parquet(f"{tmp_path}/mixed")
    order = [r.doc_id for r in mixing.mix(docs, weights={"hot": 1, "cold": 3}).orderBy("mix_slot", "mix_index").collect()]
    packed = corpus_pipeline.pack(spark, mixed, "").collect()
    by = {}
    for x in packed:
        by.setdefault(x.sequence_id >> 32, set()).add(x.doc_id)
    assert [by[k] for k in sorted(by)] == [set(order[i : i + 64]) for i in range(0, 1200, 64)]
    assert abs(sum(rows[d][2] == "cold" for k in range(4) for d in by[k]) - 192) < 16


def test_rows_are_numbered_in_the_order_of_their_files(spark, tmp_path):
    """Files whose numbers have more digits come later, larger ones aren't first, empty ones count nothing."""
    at = f"{tmp_path}/t"
    for k, (a, b) in enumerate([(0, 5), (5, 5), (5, 900), (900, 1000)]):
        spark.range(a, b).selectExpr("id as n", "repeat(string(id), 20) as `a.b`").coalesce(1).write.parquet(f"{tmp_path}/{k}")
        (tmp_path / "t").mkdir(exist_ok=True)
        for p in glob.glob(f"{tmp_path}/{k}/part-*"):
            os.rename(p, f"{at}/part-{(9, 10, 99, 100000)[k]:05d}-x-c000.snappy.parquet")
    docs = spark.read.parquet(at)
    got = numbered(docs, ["n", "a.b"], "__row").collect()
    assert len(got) == 1000 and all(r["n"] == r["__row"] and r["a.b"] == str(r["n"]) * 20 for r in got)
    for given in (docs.orderBy(F.desc("n")), docs.where("n >= 0").withColumn("_metadata", F.lit(1)).orderBy(F.desc("n"))):
        assert all(r["n"] == 999 - r["at"] for r in numbered(given, ["n"], "at").collect())
    assert numbered(docs.where("false"), ["n"], "at").collect() == []


def test_python_workers_get_batches_of_bounded_size(spark, sf, monkeypatch):
    """Long texts don't go to a worker by the 10,000; a session's own bound stays, the bound is new once."""
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat(concat('lantern ', id, ' '), 300) as text", "'en' as lang", "'s' as source")
    plain = corpus_pipeline.language_id._predict

    def predict(*args):
        run = plain(*args)

        def told(batches):
            def watched():
                for b in batches:
                    if b.nbytes > 5_000_000:
                        raise AssertionError(f"a batch of {b.nbytes} bytes")
                    yield b

            return run(watched())

        return told

    monkeypatch.setattr(corpus_pipeline.language_id, "_predict", predict)
    spark.conf.unset(BATCH_BYTES)
    assert corpus_pipeline.keep_languages(spark, docs, sf).count() == 3000
    assert not bound_batches(spark)
    spark.conf.set(BATCH_BYTES, "2m")
    assert not bound_batches(spark) and spark.conf.get(BATCH_BYTES) == "2m"
    spark.conf.unset(BATCH_BYTES)


HELPERS = (
    "score lang_pred mixture r_doc r_key b_src b_part b_n p_src p_first h_doc h_tag hits runs gone fp rep grid component component_id set_id keys key row n m t th bucket rn term which h levels "
    "doc tag units spans run piece place window seq part secret src __src __t __none __doc __key __units __order __data __hits edited before after own low high block other value plan first a.b x`y"
).split()


def with_helpers(docs):
    """Documents with columns named like what the operators make for themselves, one with a dot and one with a backtick."""
    out = docs.withColumn("extra_map", F.create_map(F.lit("a"), F.col("doc_id")))
    for i, name in enumerate(HELPERS):
        out = out.withColumn(name, F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return out


KEEPING = {
    "lines": lambda d: line_dedup.cut_repeats(d),
    "scan": lambda d: secret_scan.scan(d),
    "redact": lambda d: secret_scan.redact(d),
    "mix": lambda d: mixing.mix(d),
    "in_order": lambda d: mixing.in_order(d),
    "suffixes": lambda d: suffix_dedup.remove_repeats(d),
    "simhash": lambda d: simhash.keep_one(d),
    "similar": lambda d: similar.keep_one(d),
    "pack": lambda d: packing.pack_in_order(d),
    "stage language": lambda d: corpus_pipeline.keep_languages(d.sparkSession, d, ""),
    "stage similar": lambda d: corpus_pipeline.keep_one_of_each(d.sparkSession, d, ""),
    "stage secrets": lambda d: corpus_pipeline.hide_secrets(d.sparkSession, d, ""),
    "stage mix": lambda d: corpus_pipeline.mix_sources(d.sparkSession, d, ""),
    "stage pack": lambda d: corpus_pipeline.pack(d.sparkSession, d, ""),
}


@pytest.mark.parametrize("name", KEEPING)
def test_columns_named_like_helpers(spark, sf, name):
    """Extra columns clash with nothing and keep their values; the result is that without them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    plain, got = KEEPING[name](docs), KEEPING[name](with_helpers(docs))
    known = [c for c in plain.columns if c not in HELPERS]
    assert sorted(map(str, plain.select(known).collect())) == sorted(map(str, got.select(known).collect()))
    told = set(plain.columns) - set(docs.columns)
    for row in got.collect() if "x`y" in got.columns else []:
        for i, c in enumerate(HELPERS):
            if c not in told:
                assert row[c] == f"{i}:{row['doc_id']}", c
    assert ("x`y" in got.columns) == (name not in ("pack", "stage pack"))
