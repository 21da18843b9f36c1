"""Command line: demo, validate, run and page."""

from __future__ import annotations

import argparse
import csv
import os


def demo(folder: str) -> str:
    """Four small result tables and their catalog; returns the catalog's path."""
    os.makedirs(folder, exist_ok=True)
    effects = {"VEGFA": 2.4, "HK2": 2.0, "CA9": 3.1, "LDHA": 1.7, "EGLN3": 2.6, "RPL13A": 0.1, "ACTB": -0.05, "GAPDH": 0.4, "MYC": -1.2, "TP53": -0.8}
    rows = []
    for k, (study, paper, scale, n) in enumerate((("A_early", "A", 1.0, 3), ("A_late", "A", 1.1, 3), ("B", "B", 0.9, 4), ("C", "C", 1.2, 2))):
        with open(os.path.join(folder, f"{study}.csv"), "w", newline="") as file:
            out = csv.writer(file)
            out.writerow(["gene", "log2FoldChange", "pvalue", "padj"])
            for g, y in effects.items():
                p = min(1.0, 10 ** (-3 * abs(y) * scale + 0.1 * k))
                out.writerow([g, round(y * scale, 4), f"{p:.6g}", f"{min(1.0, p * 10):.6g}"])
        rows.append({"study_id": study, "paper_id": paper, "source_path": f"{study}.csv", "gene_column": "gene", "lfc_column": "log2FoldChange", "p_column": "pvalue", "padj_column": "padj", "source_input_type": "author_deg_table", "table_scope": "full_results", "n_ctrl": n, "n_treat": n})
    path = os.path.join(folder, "catalog.csv")
    with open(path, "w", newline="") as file:
        out = csv.DictWriter(file, rows[0])
        out.writeheader()
        out.writerows(rows)
    return path


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="concordat", description="Integrates two-group result tables into one ranked table.")
    sub = top.add_subparsers(dest="action", required=True)
    sub.add_parser("demo", help="write small tables and a catalog").add_argument("folder")
    sub.add_parser("validate", help="check a catalog without writing").add_argument("catalog")
    one = sub.add_parser("run", help="harmonise, score and write a catalog")
    one.add_argument("catalog")
    one.add_argument("output")
    one.add_argument("--min-units", default="2")
    page = sub.add_parser("page", help="show a page of written scores")
    page.add_argument("output")
    for name, kind in (("--q", str), ("--direction", str), ("--sort", str), ("--limit", int), ("--offset", int)):
        page.add_argument(name, type=kind)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.action == "demo":
        print(demo(args.folder))
        return
    from concordat import run
    from concordat.operators.consensus import least_units
    from concordat.operators.serve import entity_page
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("concordat").getOrCreate()
    if args.action == "validate":
        run.validate(spark, args.catalog).show(truncate=False)
    elif args.action == "run":
        run.run(spark, args.catalog, args.output, least_units(args.min_units))
    else:
        filters = {k: v for k, v in {"q": args.q, "direction": args.direction, "sort": args.sort, "limit": args.limit, "offset": args.offset}.items() if v is not None}
        entity_page(spark.read.parquet(f"{args.output}/scores"), **filters).select("quality_rank", "gene_symbol", "quality_score", "quality_direction", "evidence_tier").show(500, truncate=False)


if __name__ == "__main__":
    main()
