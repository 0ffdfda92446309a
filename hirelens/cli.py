"""Command line: the batch jobs of the original scripts, on stored tables.

    python -m hirelens.cli --sf-dir /root/testdata/sf0.01 health-check
    python -m hirelens.cli --silver S --bronze B clean-outlier --threshold 200 --apply --out DIR
    python -m hirelens.cli --sf-dir D train --model-dir DIR

Tables come either from stored Parquet folders (``--silver``/``--bronze``) or
are built from the driver tables (``--sf-dir``). Destructive jobs preview by
default and write a new version of both tables below ``DIR`` with
``--apply``; earlier versions and the input are never modified.
"""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens import dims


def _tables(spark, a) -> tuple[DataFrame, DataFrame]:
    from hirelens.sources import tables
    if a.snapshot:
        from hirelens.sources.sinks import read_snapshot
        return read_snapshot(spark, a.snapshot)
    if a.silver:
        if not a.bronze:
            raise SystemExit("--silver needs --bronze: the raw table cannot be derived from silver")
        return spark.read.parquet(a.silver), spark.read.parquet(a.bronze)
    return tables.silver(spark, a.sf_dir), tables.bronze(spark, a.sf_dir)


#: Lines of a report that are printed; the whole report goes to --reports.
LINES = 200


class Reports:
    """Prints the first lines of every report and, if a folder is given, writes it there whole.

    A written report is computed once: its lines are read back from the folder.
    """

    def __init__(self, folder: str | None):
        self.folder = folder

    def __call__(self, title: str, df: DataFrame) -> None:
        print(f"== {title}")
        if self.folder:
            path = f"{self.folder}/{re.sub(r'[^a-z0-9]+', '-', title.lower()).strip('-')}"
            df.write.mode("overwrite").json(path)
            df = df.sparkSession.read.schema(df.schema).json(path)
        rows = df.limit(LINES + 1).collect()
        text = df.sparkSession.createDataFrame(rows[:LINES], df.schema)
        text.show(max(1, len(rows)), truncate=False)
        if len(rows) > LINES:
            print(f"only the first {LINES} lines are printed" + ("" if self.folder else "; --reports DIR writes all"))


def _cities(a) -> list[str]:
    return a.cities.split(",") if a.cities else dims.CITIES


def _cleanup(a, _show: Reports, doomed: DataFrame, silver, bronze) -> None:
    from hirelens.operators import quality
    summary = quality.run_cleanup(silver, bronze, doomed, apply=a.apply, out=a.out)
    _show("deleted / kept" + (" (applied)" if a.apply else " (preview)"), summary)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="hirelens")
    ap.add_argument("--sf-dir", help="driver tables folder (builds bronze/silver)")
    ap.add_argument("--snapshot", help="folder that an earlier --apply wrote (both tables)")
    ap.add_argument("--silver", help="stored silver Parquet folder")
    ap.add_argument("--bronze", help="stored bronze Parquet folder")
    ap.add_argument("--master", default=None)
    ap.add_argument("--reports", default=None, help=f"folder for whole reports ({LINES} lines are printed)")
    ap.add_argument("--cities", default=None, help="comma-separated whitelist")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("health-check")
    for name in ("clean-intern", "clean-offlist", "clean-nontech", "clean-outlier"):
        p = sub.add_parser(name)
        p.add_argument("--apply", action="store_true")
        p.add_argument("--out")
        p.add_argument("--source", default="site_a")
        p.add_argument("--keyword", default="数据分析")
        p.add_argument("--threshold", type=float, default=200.0)
        p.add_argument("--words", default=None, help="comma-separated keyword override")
    for name in ("reclean", "fix-salary", "backfill"):
        p = sub.add_parser(name)
        p.add_argument("--apply", action="store_true")
        p.add_argument("--out")
    p = sub.add_parser("experience-tiers")
    p.add_argument("--source", default=None)
    sub.add_parser("inference")
    p = sub.add_parser("skills")
    p.add_argument("--json-out", default=None)
    p = sub.add_parser("train")
    p.add_argument("--model-dir", required=True)
    p = sub.add_parser("export-csv")
    p.add_argument("--out", required=True)
    a = ap.parse_args(argv)
    if not (a.sf_dir or a.silver or a.snapshot):
        ap.error("give --sf-dir, --snapshot or --silver/--bronze")
    if getattr(a, "apply", False) and not a.out:
        ap.error("--apply needs --out")

    from hirelens.session import get_spark, work_root
    spark = get_spark(a.master)
    work_root(spark)
    _show = Reports(a.reports)
    silver, bronze = _tables(spark, a)
    from hirelens.operators import ingest, inference, quality, skills, stats
    from hirelens.sources.sinks import write_snapshot

    if a.cmd == "health-check":
        _show("row counts", quality.hc_counts(silver, bronze))
        _show("duplicate key groups", quality.hc_duplicates(silver, bronze))
        _show("sources", quality.hc_sources(silver, bronze))
        _show("off-list cities", quality.hc_offlist(silver, bronze, _cities(a))
              .orderBy(F.col("n").desc()))
        _show("null / blank checks", quality.hc_nulls(silver))
        _show("salary outliers", quality.hc_salary(silver))
        _show("cities", quality.hc_cities(silver).orderBy(F.col("n").desc()))
        _show("keywords", quality.hc_keywords(silver).orderBy(F.col("n").desc()))
        _show("experience", quality.hc_experience(silver).orderBy(F.col("n").desc()))
    elif a.cmd == "clean-intern":
        words = a.words.split(",") if a.words else None
        _show("preview", quality.clean_intern_report(silver, a.source, words))
        _show("sample", quality.preview_sample(
            quality.intern_flagged(silver, a.source, words).where("flag")
            .select("source", "job_key", "city", "title", "salary_text"), 30))
        _cleanup(a, _show, quality.doomed_intern(silver, a.source, words), silver, bronze)
    elif a.cmd == "clean-offlist":
        _show("off-list rows by source/city", quality.clean_offlist_report(silver, _cities(a))
              .orderBy(F.col("n").desc()))
        # the predicate holds for each table by itself: raw rows need no silver row
        kept = quality.clean_offlist_keep(silver, bronze, _cities(a))
        for name, old, new in zip(("silver", "bronze"), (silver, bronze), kept):
            total, left = old.count(), new.count()
            print(f"{name}: {total - left} off-list, {left} kept" + (" (applied)" if a.apply else " (preview)"))
        if a.apply:
            write_snapshot(a.out, *kept)
    elif a.cmd == "clean-nontech":
        words = a.words.split(",") if a.words else None
        _show("preview", quality.clean_nontech_report(silver, a.keyword, nontech=words))
        _show("sample", quality.preview_sample(quality.nontech_dump(silver, a.keyword, nontech=words),
                                               40, "value"))
        if a.out:
            quality.nontech_dump(silver, a.keyword, nontech=words).write.mode("overwrite").text(f"{a.out}/nontech")
        _cleanup(a, _show, quality.doomed_nontech(silver, a.keyword, nontech=words), silver, bronze)
    elif a.cmd == "clean-outlier":
        _show("rows above threshold", quality.clean_outlier_report(silver, bronze, a.threshold))
        _cleanup(a, _show, quality.doomed_outlier(silver, a.threshold), silver, bronze)
    elif a.cmd == "reclean":
        _show("fields that would change", ingest.reclean_diff(silver, bronze))
        _show("experience before / after", ingest.reclean_hist(silver, bronze))
        if a.apply:
            write_snapshot(a.out, *ingest.reclean_apply(silver, bronze))
    elif a.cmd == "fix-salary":
        _show("salary re-parse", ingest.resalary_diff(silver))
        _show("sample", ingest.resalary_samples(silver))
        if a.apply:
            from hirelens.functions.salary import SALARY_COLS, with_salary
            write_snapshot(a.out, with_salary(silver.drop(*SALARY_COLS), "salary_text"), bronze)
    elif a.cmd == "backfill":
        rows = ingest.backfill_bronze(silver, bronze)
        _show("rows to add to bronze", rows.groupBy("source").count())
        if a.apply:
            write_snapshot(a.out, silver, bronze.unionByName(rows))
    elif a.cmd == "experience-tiers":
        _show("experience tiers", stats.experience_tiers(silver, a.source).orderBy("tier_ord"))
    elif a.cmd == "inference":
        for col in ("city", "education", "experience"):
            _show(f"group statistics: {col}", stats.group_describe(silver, col))
            _show(f"ANOVA: {col}", inference.anova_report(silver, col))
        pairs = {"city": None, "education": dims.EDU_PAIRS, "experience": dims.EXP_PAIRS}
        for col, pr in pairs.items():
            _show(f"post-hoc: {col}", inference.posthoc_report(silver, col, pr))
        _show("Spearman experience ~ salary", inference.spearman_report(silver))
        _show("Spearman matrix", inference.spearman_matrix(silver))
    elif a.cmd == "skills":
        jobs = skills.postings_skills(silver)
        nodes, edges = skills.skill_nodes(jobs), skills.skill_edges(jobs)
        _show("strongest edges", skills.skill_edges_top(jobs))
        _show("salary premium", skills.skill_premium(jobs))
        if a.json_out:
            from hirelens.sources.sinks import write_json
            write_json(nodes, f"{a.json_out}/nodes")
            write_json(edges, f"{a.json_out}/edges")
            write_json(skills.skill_premium(jobs), f"{a.json_out}/premium")
    elif a.cmd == "train":
        from hirelens.operators import ml
        report = ml.train(ml.ml_frame(silver), a.model_dir, _cities(a))
        print(json.dumps(report, ensure_ascii=False, indent=2))
    elif a.cmd == "export-csv":
        from hirelens.sources.sinks import export_csv
        export_csv(silver, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
