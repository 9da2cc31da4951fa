"""python -m tsengine [--weather CSV] READINGS.parquet START END WIDTH_SECONDS OUT EFFECT...: runs the analysis and writes its
tables to OUT.

READINGS has sensor, t (microseconds), value; START and END are 'yyyy-MM-dd'; CSV is a file or folder of weather rows.
"""

from __future__ import annotations

import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from tsengine.model import SECOND
from tsengine.plans.analysis import analyse
from tsengine.sources import exports, files


def main(args: list[str]) -> int:
    weather = None
    if args[:1] == ["--weather"]:
        weather, args = args[1], args[2:]
    if len(args) < 6:
        print(__doc__)
        return 2
    path, begin, finish, width, out, *effects = args
    start, end = (int(datetime.strptime(d, "%Y-%m-%d").replace(tzinfo=timezone.utc).timestamp()) * SECOND for d in (begin, finish))
    spark = SparkSession.builder.appName("tsengine").getOrCreate()
    a = analyse(files.read_readings(spark, path, start, end), start, end, int(width) * SECOND, effects, weather=files.read_weather_csv(spark, weather) if weather else None)
    for name in ("purged", "features", "clusters", "states", "ranked", "edges", "failures"):
        getattr(a, name).write.mode("overwrite").parquet(f"{out}/{name}")
    files.write_json(exports.graph_json(a.edges), f"{out}/graphs")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
