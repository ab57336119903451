"""python -m lexiforge STORE status | rebuild NAME TABLE KEY COLUMNS | flush NAME | clear | explain TABLE KEY COLUMNS TERM | benchmark TABLE KEY COLUMNS TERM [RUNS] | content NAME TABLE KEY COLUMNS OUT | shadow TABLE COLUMN OUT

TABLE and OUT are Parquet paths, COLUMNS are names with commas between. content writes the columns as one text per
row, replacing what OUT has of that name; shadow writes the table with a column of the sound of COLUMN.
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import SparkSession

from lexiforge.operators.matching import add_shadow_column
from lexiforge.operators.search import Search
from lexiforge.sources.index import IndexStore, content_table


def benchmark(s: Search, runs: int = 10) -> dict[str, float | str]:
    """Least, mean and greatest milliseconds of a search, runs a second, and a rating."""
    took = []
    for _ in range(runs):
        t = time.perf_counter()
        s.get().collect()
        took.append((time.perf_counter() - t) * 1000)
    mean = sum(took) / len(took)
    rating = next((name for most, name in ((10, "excellent"), (50, "good"), (100, "moderate")) if mean < most), "slow")
    return {"max_ms": round(max(took), 2), "mean_ms": round(mean, 2), "min_ms": round(min(took), 2), "per_second": round(1000 / mean, 2), "rating": rating}


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    store, verb, rest = IndexStore(spark, args[0]), args[1], args[2:]

    def search(path: str, key: str, columns: str, term: str) -> Search:
        return Search(spark.read.parquet(path), key).search(term).search_in(columns.split(","))

    if verb == "status":
        store.status().show(truncate=False)
    elif verb == "rebuild" and len(rest) == 4:
        store.rebuild(rest[0], spark.read.parquet(rest[1]), rest[2], rest[3].split(","))
    elif verb == "flush" and len(rest) == 1:
        store.flush(rest[0])
    elif verb == "clear" and not rest:
        store.clear()
    elif verb == "explain" and len(rest) == 4:
        s = search(*rest)
        print(json.dumps({"analytics": s.analytics(), "patterns": s.patterns()}, indent=1, ensure_ascii=False))
        s.explain()
        s.take(5).get().show(truncate=False)
    elif verb == "benchmark" and len(rest) in (4, 5):
        print(json.dumps(benchmark(search(*rest[:4]), int(rest[4]) if len(rest) == 5 else 10)))
    elif verb == "content" and len(rest) == 5:
        rows = content_table(spark.read.parquet(rest[1]), rest[0], rest[2], rest[3].split(","))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(rest[4])
    elif verb == "shadow" and len(rest) == 3:
        add_shadow_column(spark.read.parquet(rest[0]), rest[1]).write.mode("overwrite").parquet(rest[2])
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
