"""``python -m auditloom <folder> [--out <folder>] [--rules <file>]``: audit all projects under a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import audit, documents, svg
from .sources import sinks


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="auditloom", description="Audit all semantic model projects under a folder.")
    parser.add_argument("source", help="folder that holds the projects")
    parser.add_argument("--out", help="folder for the relations (JSON) the documents and the charts (text)")
    parser.add_argument("--rules", help="YAML rule file")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("auditloom").getOrCreate()
    with audit.analyze(spark, given.source, given.rules) as r:
        scores = r["project_scores"].orderBy("project")
        for row in scores.toLocalIterator():
            print(f"{row['project']}: {row['global_score']} {row['grade']} ({row['critical']} critical, {row['warnings']} warnings, {row['infos']} infos)")
        skipped = [row["project"] for row in r["skipped_projects"].orderBy("project").toLocalIterator()]
        for project in skipped:
            print(f"{project}: skipped, no definition files")
        if given.out:
            sinks.write_relations(r, f"{given.out.rstrip('/')}/data")
            sinks.assembled(documents.all_documents(r)).withColumn("file", F.concat("document", F.lit(".md"))).write.mode("overwrite").partitionBy("project").json(f"{given.out.rstrip('/')}/documents")
            sinks.assembled(svg.drawings(r)).withColumnRenamed("document", "file").write.mode("overwrite").partitionBy("project").json(f"{given.out.rstrip('/')}/charts")
            print(f"{len(r)} relations, the documents and the charts are in {given.out}")
        print(f"{scores.count()} projects, {len(skipped)} skipped")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
