"""Query: resumed processing of newly arrived files."""

from pyspark.sql import functions as F

from tilewright.plans.registry import query, r6
from tilewright.plans.roles import CELLS, CENTERS, SOFT, cells, centers
from tilewright.session import new_path
from tilewright.streaming.incremental import process_new_files


@query("S30", f"with {CELLS}, {CENTERS}, {SOFT} select sample_name, node_idx, k as prototype, round(cosine, 6) as cosine from soft where rk = 1")
def resumed_assignment(spark, sf):
    from tilewright.operators.prototypes import assign_hard

    root = new_path(spark, "arriving")
    c = cells(spark, sf).select("sample_name", "node_idx", "embedding")
    known = centers(spark, sf)
    score = lambda df: assign_hard(df, known).select("sample_name", "node_idx", "prototype", "cosine")
    run = lambda: process_new_files(spark, f"{root}/in", c.schema, score, f"{root}/out", f"{root}/log")
    first = F.substring("sample_name", 2, 1).cast("int") < 5
    c.where(first).write.mode("append").parquet(f"{root}/in")
    run()
    c.where(~first).write.mode("append").parquet(f"{root}/in")
    return run().withColumns(r6("cosine"))
