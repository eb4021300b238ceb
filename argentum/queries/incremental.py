"""Incremental processing, the ledger (T) and the extension surface (U)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from argentum.operators import faces, pending
from argentum.sources.catalogs import PROVIDERS
from argentum.storage import folders_in, scratch_dir, table
from argentum.streaming import ledger, watch

from .registry import EFF, EFF_MIME, VIDEO, query, raw_query


@raw_query("t01_watch", "SELECT conv_id, max(turn) AS turns, count(*) AS n FROM conversations GROUP BY conv_id")
def watched(spark, sf_dir):
    """Conversations arrive as a file stream; each batch is upserted into a table by its key."""
    kind = "conv_id bigint, turn bigint, role string, text string"
    base = f"{scratch_dir(spark)}/watch-{uuid.uuid4().hex[:8]}"
    source = f"{base}/drop"
    table(spark, sf_dir, "conversations").repartition(4, "conv_id").write.parquet(source)

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/table/batch={batch_id}")

    stream = watch.record_stream(spark, source, kind)
    watch.watch(stream, [("broken", lambda b, i: 1 / 0), ("store", store)], f"{base}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{base}/table").groupBy("conv_id").agg(F.max("turn").alias("turns"), F.count("*").alias("n"))


@query("t02_cycle", "SELECT stage, cycle, outcome, CASE WHEN n = 'even' THEN (SELECT count(*) FROM file_hashes WHERE size_bytes % 2 = 0) WHEN n = 'all' THEN (SELECT count(*) FROM file_hashes) ELSE 0 END AS stored FROM (VALUES ('scan', 1, 'ok', 'even'), ('faces', 1, 'failed: boom', 'none'), ('scan', 2, 'ok', 'all'), ('faces', 2, 'ok', 'all')) t(stage, cycle, outcome, n)")
def cycle(lib):
    """Two batches; a stage that fails on the first has both after the second cycle."""
    base = f"{scratch_dir(lib.spark)}/cycle-{uuid.uuid4().hex[:8]}"
    broken = [True]

    def store(name):
        def stage(batch, batch_id):
            if name == "faces" and broken:
                broken.pop()
                raise RuntimeError("boom")
            batch.select("path").write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")

        return stage

    rows = []
    for i in (0, 1):
        got = watch.run_cycle(lib.file_hashes.where(F.col("size_bytes") % 2 == i), i, [(n, store(n)) for n in ("scan", "faces")], f"{base}/failed")
        for name, outcome in got.items():
            there = "batch=0" in folders_in(lib.spark, f"{base}/{name}")
            rows.append((name, i + 1, outcome, lib.spark.read.parquet(f"{base}/{name}").count() if there else 0))
    return lib.spark.createDataFrame(rows, "stage string, cycle int, outcome string, stored bigint")


@query("t03_scan_stage", "SELECT path, CASE WHEN ext = 'gif' THEN 'x' ELSE hash END AS hash FROM file_hashes")
def scan_stage(lib):
    return pending.upsert(lib.file_hashes, lib.file_hashes.where("ext = 'jpg'"), ["path"]).select("path", "hash")


@query("t04_faces_stage", "SELECT count(*) AS todo FROM (SELECT hash FROM file_hashes EXCEPT (SELECT hash FROM faces_scanned UNION SELECT hash FROM faces))")
def faces_stage(lib):
    return pending.select_unscanned(lib.file_hashes, lib.faces_scanned, lib.faces).agg(F.count("*").alias("todo"))


@query("t06_retry_incomplete", "SELECT path FROM file_hashes WHERE mime IS NULL")
def retry(lib):
    return pending.difference(lib.file_hashes.select("path"), pending.known_mime_paths(lib.file_hashes))


@query("t07_ledger_row", "SELECT command, status FROM pipeline_runs WHERE command <> 'faces' UNION ALL SELECT 'faces', 'success'")
def ledger_row(lib):
    return ledger.finished(lib.pipeline_runs, "faces", "2024-01-02 02:00:00", "success", 5, None).select("command", "status")


@query("t08_status", "SELECT * FROM (VALUES ('scan','success'),('faces','crashed'),('embed','success'),('classify','never'),('dedupe','failed'),('fix-dates','never'),('prune','never'),('locations','never')) t(command, state)")
def status(lib):
    return ledger.status(lib.pipeline_runs).select("command", "state")


@query("t08_status_locked", "SELECT 'faces' AS command, 'running' AS state")
def status_locked(lib):
    return ledger.status(lib.pipeline_runs, ["faces"]).where("command = 'faces'").select("command", "state")


@query("t12_prune_stage", "SELECT count(*) AS removals FROM file_hashes WHERE ext = 'webp'")
def prune_stage(lib):
    parents = lib.file_hashes.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("parent")).distinct()
    plan = pending.prune_plan(lib.file_hashes, lib.file_hashes.where("ext <> 'webp'").select("path"), parents)
    return plan.where("action = 'remove'").agg(F.count("*").alias("removals"))


class _Embedder:
    """Stands for a model: any text is the first stored vector."""

    def __init__(self, lib):
        self.lib = lib

    def embed(self, text=None, image=None):
        return list(self.lib.embeddings.where("model_id = 'acme/base-224' AND vec_id = 0").select("embedding").head().embedding)


@query("u01_query_embedder", "WITH e AS (SELECT hash, list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM emb WHERE model_id = 'acme/base-224' AND vec_id = 0)), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS s FROM emb WHERE model_id = 'acme/base-224' AND hash IN (SELECT hash FROM file_hashes WHERE ext = 'jpg')), t AS (SELECT * FROM e ORDER BY s DESC, hash LIMIT 10) SELECT path, round(s, 6) AS score FROM file_hashes JOIN t USING (hash) ORDER BY s DESC, path LIMIT 10")
def ranked_by_text(lib):
    return lib.search(text="anything", embedder=_Embedder(lib), exts=["jpg"], k=10).select("path", F.round("score", 6).alias("score"))


@query("u02_providers", "SELECT * FROM (VALUES (0, 'apple-photos'), (1, 'lightroom'), (2, 'google-takeout')) t(pos, provider)")
def providers(lib):
    return lib.spark.createDataFrame(list(enumerate(PROVIDERS)), "pos int, provider string")


@query("u03_stats_tool", "SELECT count(*) AS total_files, count(DISTINCT hash) AS unique_files FROM file_hashes")
def stats_tool(lib):
    from argentum.operators.stats import tool_stats

    return tool_stats(lib.file_hashes, lib.embeddings).select("total_files", "unique_files")


@query("u04_duplicates_tool", "SELECT count(*) AS total_files, (SELECT count(*) FROM (SELECT hash FROM file_hashes GROUP BY hash HAVING count(*) > 1)) AS n_groups FROM file_hashes")
def duplicates_tool(lib):
    j = F.from_json("document", "total_files bigint, duplicate_groups array<struct<hash:string>>")
    return lib.find_duplicates().select(j["total_files"].alias("total_files"), F.size(j["duplicate_groups"]).cast("bigint").alias("n_groups"))


@query("u05_search_tool", f"SELECT path, {EFF} AS date FROM file_hashes WHERE hash IN (SELECT hash FROM file_hashes WHERE {EFF_MIME} IN {VIDEO}) AND hash IN (SELECT hash FROM faces WHERE confirmed = 1 AND person_label = 'person_4') ORDER BY date DESC NULLS LAST, path LIMIT 20")
def search_tool(lib):
    return lib.search(person="person_4", kinds=["video"]).select("path", "date")


@query("u06_read_api", "SELECT (SELECT count(DISTINCT person_label) FROM faces WHERE confirmed = 1 AND person_label IS NOT NULL) AS n_people, (SELECT count(DISTINCT cluster_id) FROM faces WHERE cluster_id IS NOT NULL AND (confirmed = 0 OR person_label IS NULL)) AS n_clusters")
def read_api(lib):
    people, clusters, _ = lib.faces_view()
    return people.agg(F.count("*").alias("n_people")).join(clusters.agg(F.count("*").alias("n_clusters")))


@query("u07_mutation_api", "SELECT count(*) AS labelled FROM faces WHERE person_label = 'person_0' OR id IN (1, 2)")
def mutation_api(lib):
    changed, _ = faces.assign(lib.faces, lib.people, [1, 2], "person_0")
    return changed.where("person_label = 'person_0'").agg(F.count("*").alias("labelled"))


@query("u10_sql_surface", "SELECT ext, count(*) AS files FROM file_hashes WHERE size_bytes > 1000 GROUP BY ext")
def sql_surface(lib):
    return lib.sql("SELECT ext, count(*) AS files FROM file_hashes WHERE size_bytes > 1000 GROUP BY ext")


