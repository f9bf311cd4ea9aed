"""What the stores of scans, findings and coverage become after a write, as DataFrames: old rows in, new rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.operators.ranking import same

TERMINAL = ("COMPLETED", "COMPLETED_WITH_WARNINGS", "FAILED", "CANCELLED")
COMPLETED = TERMINAL[:2]


def not_fixed(status: Column) -> Column:
    """Whether a finding is a current one; a missing status is."""
    return ~status.eqNullSafe(F.lit("fixed"))


def inserted(stored: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``stored`` and those of ``rows`` whose keys are new, the first by ``order`` of each; conflicts are left out."""
    columns = [c for c in stored.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_sg_row"))
    new = first.select(*keys, *(F.col(f"_sg_row.{c}").alias(c) for c in columns)).select(*stored.columns).alias("n")
    known = stored.select(*(F.col(k).alias(f"_sg_{k}") for k in keys)).distinct()
    return stored.unionByName(new.join(known, same(new, known, [(k, f"_sg_{k}") for k in keys]), "left_anti").select(*stored.columns))


def replaced(stored: DataFrame, rows: DataFrame, where: Column, keys: list[str], order: str) -> DataFrame:
    """``stored`` with what ``where`` picks taken out and ``rows`` put in; of equal keys the stored row, else the first new one stays.

    Replacing one analyzer's findings, a scan's, or only its fixed ones differ in ``where``.
    """
    return inserted(stored.where(~F.coalesce(where, F.lit(False))), rows, keys, order)


def updated(stored: DataFrame, changes: DataFrame, keys: list[str], removed: DataFrame | None = None) -> DataFrame:
    """``stored`` with the columns of ``changes`` written over rows of the same keys, and without the keys of ``removed``; nothing is added."""
    values = [c for c in changes.columns if c not in keys]
    marked = changes.select(*(F.col(k).alias(f"_sg_k_{k}") for k in keys), F.struct(*values).alias("_sg_new"))
    kept = stored if removed is None else stored.join(removed.select(*keys).distinct(), keys, "left_anti")
    joined = kept.join(marked, same(kept, marked, [(k, f"_sg_k_{k}") for k in keys]), "left")
    return joined.select(*(F.when(F.col("_sg_new").isNotNull(), F.col(f"_sg_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in stored.columns))


def upserted_keeping(stored: DataFrame, rows: DataFrame, keys: list[str], id_: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """``stored`` with ``rows`` written over rows of the same keys, which keep their id (and the columns of ``kept``), and others added."""
    columns = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("_sg_new", F.lit(0)).unionByName(rows.withColumn("_sg_new", F.lit(1)))
    row = lambda f: f(F.struct(*columns), "_sg_new")
    merged = both.groupBy(*keys).agg(row(F.min_by).alias("_sg_old"), row(F.max_by).alias("_sg_last"))
    return merged.select(*keys, *(F.col(f"_sg_{'old' if c in (id_, *kept) else 'last'}.{c}").alias(c) for c in columns)).select(*stored.columns)


def coverage_replaced(stored: DataFrame, entries: DataFrame, order: str) -> DataFrame:
    """scan_id, analyzer, path and status: the scans of ``entries`` get its rows instead of their own, the last by ``order`` of each path."""
    last = entries.groupBy("scan_id", "analyzer", "path").agg(F.max_by("status", order).alias("status"))
    return stored.join(entries.select("scan_id").distinct(), "scan_id", "left_anti").select("scan_id", "analyzer", "path", "status").union(last)


def without_repos(tables: dict[str, DataFrame], scans: DataFrame, repos: DataFrame) -> dict[str, DataFrame]:
    """Each of ``tables`` (with scan_id or repo_id) and scans without what belongs to ``repos`` (repo_id); bases that are gone are cleared."""
    gone = scans.join(repos.select("repo_id").distinct(), "repo_id", "left_semi").select(F.col("id").alias("scan_id"))
    out = {name: df.join(gone, "scan_id", "left_anti") if "scan_id" in df.columns else df.join(repos.select("repo_id").distinct(), "repo_id", "left_anti") for name, df in tables.items()}
    left = scans.join(repos.select("repo_id").distinct(), "repo_id", "left_anti")
    dead = gone.withColumnRenamed("scan_id", "base_scan_id").withColumn("_sg_dead", F.lit(True))
    cleared = left.join(dead, "base_scan_id", "left").withColumn("base_scan_id", F.when(F.col("_sg_dead").isNull(), F.col("base_scan_id")))
    return out | {"scans": cleared.select(*scans.columns)}


def transitioned(scans: DataFrame, asked: DataFrame, now: Column, once: bool = True) -> DataFrame:
    """``scans`` (id, state, error_code, started_at, finished_at and others) after ``asked`` (id, to_state, code).

    With ``once`` a terminal state stays. started_at is set by the first state that isn't QUEUED, finished_at by a terminal
    one; an error code is kept only by FAILED.
    """
    joined = scans.join(asked.withColumnRenamed("id", "_sg_id"), F.col("id") == F.col("_sg_id"), "left")
    moves = F.col("to_state").isNotNull() & (~F.col("state").isin(*TERMINAL) if once else F.lit(True))
    to = F.col("to_state")
    set_ = {
        "state": F.when(moves, to).otherwise(F.col("state")), "error_code": F.when(moves, F.when(to == "FAILED", F.col("code"))).otherwise(F.col("error_code")),
        "started_at": F.when(moves & F.col("started_at").isNull() & (to != "QUEUED"), now).otherwise(F.col("started_at")), "finished_at": F.when(moves & to.isin(*TERMINAL), now).otherwise(F.col("finished_at")),
    }
    return joined.select(*(set_[c].alias(c) if c in set_ else F.col(c) for c in scans.columns))


def with_warnings(scans: DataFrame, added: DataFrame, order: str, dropped_stages: list[str] | None = None) -> DataFrame:
    """``scans`` (id, warnings and others) whose warnings (array of structs with stage) lose those of the dropped stages and gain ``added`` (scan_id, warning)."""
    new = added.groupBy(F.col("scan_id").alias("_sg_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "warning"))), lambda w: w["warning"]).alias("_sg_new"))
    joined = scans.join(new, F.col("id") == F.col("_sg_id"), "left")
    kept = F.filter("warnings", lambda w: ~F.coalesce(w["stage"].isin(*(dropped_stages or ())), F.lit(False)))
    return joined.withColumn("warnings", F.concat(kept, F.coalesce("_sg_new", F.slice("warnings", 1, 0)))).select(*scans.columns)


def with_cost(scans: DataFrame, calls: DataFrame) -> DataFrame:
    """``scans`` with the cost of ``calls`` (scan_id, cost_usd) added to cost_usd."""
    sums = calls.groupBy(F.col("scan_id").alias("_sg_id")).agg(F.sum("cost_usd").alias("_sg_cost"))
    return scans.join(sums, F.col("id") == F.col("_sg_id"), "left").withColumn("cost_usd", F.col("cost_usd") + F.coalesce("_sg_cost", F.lit(0.0))).select(*scans.columns)


def baselines(scans: DataFrame, most: int = 10) -> DataFrame:
    """id, base_id and place: earlier completed scans of one repository, options and ref, newest first.

    scans: id, repo_id, ref, options, commit, state, created_at, finished_at. A null ref is one of its own; refs that are a
    commit's hash are all alike. A scan without options has none. Scans of one key are joined, so what meets is what a
    repository's branch has.
    """
    ref = F.when(F.col("ref").rlike("(?i)^[0-9a-f]{40}$"), "\0pinned").otherwise(F.col("ref"))
    mine = scans.where("options is not null").select("id", F.col("repo_id").alias("m_repo"), ref.alias("m_ref"), F.col("options").alias("m_options"), F.col("created_at").alias("m_created"))
    base = scans.where(F.col("state").isin(*COMPLETED) & F.col("commit").isNotNull()).select(F.col("id").alias("base_id"), "repo_id", ref.alias("ref"), "options", "created_at", "finished_at")
    keys = [("m_repo", "repo_id"), ("m_options", "options"), ("m_ref", "ref")]
    met = mine.join(base, same(mine, base, keys) & (F.col("created_at") <= F.col("m_created")) & (F.col("id") != F.col("base_id")))
    tops = met.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("finished_at", "base_id")), False), 1, most).alias("tops"))
    return tops.select("id", F.posexplode("tops").alias("place", "b")).select("id", F.col("b.base_id").alias("base_id"), (F.col("place") + 1).alias("place"))


def active_duplicates(scans: DataFrame, asked: DataFrame) -> DataFrame:
    """repo_id, ref, options and id of the newest scan that isn't over and was asked for alike; null refs are equal."""
    live = scans.where(~F.col("state").isin(*TERMINAL))
    newest = live.groupBy("repo_id", "ref", "options").agg(F.max(F.struct("created_at", "id")).alias("top"))
    a = asked.select(*(F.col(c).alias(f"_sg_{c}") for c in ("repo_id", "ref", "options"))).distinct()
    return a.join(newest, same(a, newest, [(f"_sg_{c}", c) for c in ("repo_id", "ref", "options")])).select("repo_id", "ref", "options", F.col("top.id").alias("id"))


def cache_sources(scans: DataFrame) -> DataFrame:
    """repo_id, commit, options, versions and id: the newest clean scan that can be copied for each. One with a warning that isn't info can't, nor can a copy."""
    loud = F.exists("warnings", lambda w: F.coalesce(w["level"], F.lit("warning")) != "info")
    clean = (F.col("state") == "COMPLETED") | ((F.col("state") == "COMPLETED_WITH_WARNINGS") & ~F.coalesce(loud, F.lit(False)))
    rows = scans.where(clean & (F.col("cache_hit") != "full"))
    return rows.groupBy("repo_id", "commit", "options", "versions").agg(F.max_by("id", F.struct("finished_at", "id")).alias("id"))


def diff_status(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, status (A, D, M or R) and old_path between two trees (path, blob): a deleted and an added file of one blob are a rename, in order of their names."""
    b, h = base.select(F.col("path").alias("b_path"), F.col("blob").alias("b_blob")), head.select(F.col("path").alias("h_path"), F.col("blob").alias("h_blob"))
    both = b.join(h, F.col("b_path") == F.col("h_path"), "full").where("not (b_blob <=> h_blob) or b_path is null or h_path is null")
    gone, new = both.where("h_path is null").select("b_path", "b_blob"), both.where("b_path is null").select("h_path", "h_blob")
    lists = lambda df, c, blob: df.groupBy(F.col(blob).alias("blob")).agg(F.sort_array(F.collect_list(c)).alias(c))
    pairs = lists(gone, "b_path", "b_blob").join(lists(new, "h_path", "h_blob"), "blob").select(F.explode(F.arrays_zip("b_path", "h_path")).alias("p")).select("p.b_path", "p.h_path").where("b_path is not null and h_path is not null")
    moved = pairs.select(F.col("h_path").alias("path"), F.lit("R").alias("status"), F.col("b_path").alias("old_path"))
    none = F.lit(None).cast("string")
    added = new.join(pairs.select("h_path"), "h_path", "left_anti").select(F.col("h_path").alias("path"), F.lit("A").alias("status"), none.alias("old_path"))
    deleted = gone.join(pairs.select("b_path"), "b_path", "left_anti").select(F.col("b_path").alias("path"), F.lit("D").alias("status"), none.alias("old_path"))
    return both.where("b_path is not null and h_path is not null").select(F.col("b_path").alias("path"), F.lit("M").alias("status"), none.alias("old_path")).union(moved).union(added).union(deleted)


def reuse_stats(calls: DataFrame, base: DataFrame, now: DataFrame) -> DataFrame:
    """analyzer, reviewed, reused and saved: the base scan's cost of the files that it reviewed and that are cached now.

    calls: analyzer, cost_usd. base, now: analyzer, path, status.
    """
    cost = calls.groupBy("analyzer").agg(F.sum("cost_usd").alias("cost")).where("cost > 0")
    seen = base.where(F.col("status").isin("reviewed", "reviewed-fast")).select("analyzer", "path")
    cached = now.where("status = 'cached'").select("analyzer", "path").distinct().withColumn("_sg_cached", F.lit(1))
    sums = seen.join(cached, ["analyzer", "path"], "left").groupBy("analyzer").agg(F.count("*").alias("reviewed"), F.count("_sg_cached").alias("reused"))
    return sums.join(cost, "analyzer").select("analyzer", "reviewed", "reused", F.round(F.col("cost") * F.col("reused") / F.col("reviewed"), 6).alias("saved"))


def reference_list(ids: Column, known: Column) -> Column:
    """Those of ``ids`` that are among ``known``, in their order."""
    return F.filter(ids, lambda i: F.array_contains(known, i))


def triaged(suppressions: DataFrame, decisions: DataFrame, order: str) -> DataFrame:
    """repo_id, fingerprint, status, expires_at: ``suppressions`` after ``decisions`` (repo_id, keys, status, expires_at), each written under all its
    keys; the last by ``order`` of a key counts, and one of a null status clears it."""
    new = decisions.select("repo_id", F.explode("keys").alias("fingerprint"), F.struct(F.lit(1).alias("new"), order, "status", "expires_at").alias("row"))
    old = suppressions.select("repo_id", "fingerprint", F.struct(F.lit(0).alias("new"), F.lit(None).cast(decisions.schema[order].dataType).alias(order), "status", "expires_at").alias("row"))
    last = old.union(new).groupBy("repo_id", "fingerprint").agg(F.max_by("row", F.struct("row.new", f"row.{order}")).alias("row"))
    return last.where("row.status is not null").select("repo_id", "fingerprint", "row.status", "row.expires_at")
