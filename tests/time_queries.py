"""Warm timings with a no-op sink: python tests/time_queries.py sf_dir prefix ..."""
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from plumbline.plans import queries as Q  # noqa: E402
from plumbline.session import build_session  # noqa: E402

spark = build_session("time", "local[8]", spark__sql__shuffle__partitions="8",
                      spark__ui__enabled="false", spark__driver__memory="8g")
spark.sparkContext.setLogLevel("OFF")
Q.load()
sf = sys.argv[1]
for name, fn in Q.QUERIES.items():
    if not any(name.startswith(p) for p in sys.argv[2:]):
        continue
    took = []
    for _ in range(3):
        t = time.time()
        df = fn(spark, sf)
        built = time.time() - t
        df.write.format("noop").mode("overwrite").save()
        took.append(time.time() - t)
    print(f"{name:40s} first {took[0]:6.2f}  best {min(took[1:]):6.2f}  plan {built:5.2f}", flush=True)
