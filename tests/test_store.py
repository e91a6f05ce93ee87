"""The store of chunks, postings and graph: touched buckets only, batches that fail and come again."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.sources import store


def vector(content):
    return F.array(F.length(content).cast("double"))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def text(n, word="text"):
    return f"{word} number {n}. " * 60


def graph(chunks):
    """A node for each document and an edge from it to its first word."""
    rows = chunks.filter("chunk_id = 0").select("doc_id", F.split("content", " ")[0].alias("word"))
    stamp = F.lit(None).cast("timestamp")
    props = F.create_map(F.lit("word"), F.col("word")).alias("properties")
    nodes = rows.select(F.concat(F.lit("D"), "doc_id").alias("id"), F.col("word").alias("name"), props, stamp.alias("created_at"), stamp.alias("updated_at"))
    return nodes, rows.select(F.concat("doc_id", F.lit(">"), "word").alias("id"), F.concat(F.lit("D"), "doc_id").alias("src"), F.col("word").alias("dst"), stamp.alias("created_at"), stamp.alias("updated_at"))


def check(spark, path, want):
    """The store holds these documents: chunks, vectors and postings."""
    chunks = documents(spark, list(want.items())).select("doc_id", F.inline(tx.fixed_chunks(F.col("text"), 512))).collect()
    got = sorted((r["doc_id"], r["chunk_id"], r["content"], r["embedding"], r["id"]) for r in store.read_side(spark, path, "chunks").collect())
    assert got == sorted((r["doc_id"], r["position"], r["content"], [float(len(r["content"]))], f"{r['doc_id']}_{r['position']}") for r in chunks)
    sizes = {(r["doc_id"], r["chunk_id"]): r["n"] for r in store.read_side(spark, path, "index").groupBy("doc_id", "chunk_id").agg(F.sum("tf").alias("n"), F.max("dl").alias("dl")).filter("n = dl").collect()}
    assert sorted(sizes) == sorted((g[0], g[1]) for g in got)


def test_changed_documents_are_taken_in(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.maintain(documents(spark, [(n, text(n)) for n in range(6)]), "a", path, vector, graph=graph, buckets=8)
    assert not store.maintain(documents(spark, [(0, "other")]), "a", path, vector, graph=graph, buckets=8)
    assert store.maintain(documents(spark, [(2, text(2, "new")), (2, "a"), (7, text(7)), (5, "")]), "b", path, vector, graph=graph, buckets=8)
    want = {n: text(n) for n in range(5)} | {2: text(2, "new"), 7: text(7)}
    check(spark, path, want)
    nodes = {r["id"]: (r["name"], r["updated_at"] is not None) for r in store.read_side(spark, path, "entities").collect()}
    assert nodes == {f"D{n}": ("new" if n == 2 else "text", n in (2, 7)) for n in [0, 1, 2, 3, 4, 5, 7]}
    assert {r["id"] for r in store.read_side(spark, path, "relations").collect()} == {f"{n}>text" for n in [0, 1, 2, 3, 4, 5, 7]} | {"2>new"}


def test_delete_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    store.maintain(documents(spark, [(n, text(n)) for n in range(12)]), "a", path, vector, buckets=8)
    files = lambda: {side: {str(p.relative_to(tmp_path)) for p in (tmp_path / "store" / side).rglob("*.parquet")} for side in ("chunks", "index")}
    bucket = lambda ids: {r[0] for r in documents(spark, [(i, "") for i in ids]).select(store.bucket_of("doc_id", 8)).collect()}
    before = files()
    gone = [1, 4]
    assert store.delete_documents(spark, path, documents(spark, [(i, "") for i in gone]).select("doc_id"), "b", buckets=8)
    check(spark, path, {n: text(n) for n in range(12) if n not in gone})
    for side, was in before.items():
        kept = {f for f in was if not any(f"bucket={b}/" in f for b in bucket(gone))}
        assert kept and kept == {f for f in files()[side] if not any(f"bucket={b}/" in f for b in bucket(gone))}
    # A bucket that nothing is left in is empty, too.
    store.delete_documents(spark, path, documents(spark, [(i, "") for i in range(12)]).select("doc_id"), "c", buckets=8)
    assert store.read_side(spark, path, "chunks").count() == 0 and store.read_side(spark, path, "index").count() == 0


@pytest.mark.parametrize("fails_at", ["pend-1", "pend-2", "apply-1", "apply-2", "ledger"])
def test_a_batch_that_fails_half_way_is_finished(spark, tmp_path, monkeypatch, fails_at):
    path = str(tmp_path / "store")
    store.maintain(documents(spark, [(n, text(n)) for n in range(4)]), "a", path, vector, buckets=4)
    step, at = fails_at.split("-") if "-" in fails_at else (fails_at, "0")
    calls = []

    def broken_pend(spark, path, place, side, *rest, real=store._pend):
        calls.append(side)
        if len(calls) == int(at):
            raise RuntimeError("lost")
        real(spark, path, place, side, *rest)

    def broken_apply(spark, path, place, batch_id):
        sides = list(store.SIDES)[: int(at)]
        for side in sides:
            rows = store.read_or_none(spark, f"{place}/{side}")
            if rows is not None:
                rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{side}")
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        if step == "pend":
            broken.setattr(store, "_pend", broken_pend)
        elif step == "apply":
            broken.setattr(store, "_apply", broken_apply)
        else:
            broken.setattr(store, "discard", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.maintain(documents(spark, [(1, text(1, "new")), (9, text(9))]), "b", path, vector, buckets=4)
    want = {n: text(n) for n in range(4)} | {1: text(1, "new"), 9: text(9)}
    if step == "apply" and at == "1":
        # Another batch finishes what was begun before its own.
        store.maintain(documents(spark, [(3, text(3, "third"))]), "c", path, vector, buckets=4)
        want[3] = text(3, "third")
    store.maintain(documents(spark, [(1, text(1, "new")), (9, text(9))]), "b", path, vector, buckets=4)
    check(spark, path, want)
    assert sorted(r[0] for r in spark.read.parquet(f"{path}/ledger").collect()) == (["a", "b", "c"] if 3 in want and want[3] != text(3) else ["a", "b"])


def test_stream_into_the_store(spark, tmp_path):
    rows = documents(spark, [(i, text(i)) for i in range(6)])
    source, path = str(tmp_path / "new"), str(tmp_path / "store")
    for part in (rows.filter("doc_id < 4"), rows.filter("doc_id >= 2"), documents(spark, [(3, text(3, "changed"))])):
        part.coalesce(1).write.mode("append").parquet(source)
        store.maintained(spark.readStream.schema(rows.schema).parquet(source), path, vector, str(tmp_path / "state"), graph=graph).awaitTermination()
    check(spark, path, {i: text(i) for i in range(6)} | {3: text(3, "changed")})
    assert {r["id"]: r["name"] for r in store.read_side(spark, path, "entities").collect()}["D3"] == "changed"
