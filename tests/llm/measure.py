"""Figures that the README gives: python tests/llm/measure.py FOLDER...

alignment: of the blocks with markup those whose tree (kinds of nodes in order) stands in no other document of their site.
"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))


def alignment(spark, root):
    from pyspark.sql import functions as F

    from blockloom.llm import markup
    from blockloom.tables import table

    blocks = table(spark, root, "blocks")
    nodes = markup.clean(blocks).select("block_id", F.array_join("nodes", ",").alias("shape"))
    rows = nodes.join(blocks.select("block_id", "document_id", "site").dropDuplicates(["block_id"]), "block_id")
    on = rows.where("site is not null").groupBy("site", "shape").agg(F.countDistinct("document_id").alias("documents"))
    got = rows.join(on, ["site", "shape"], "left").agg(F.count("*").alias("n"), F.count_if(F.col("documents") == 1).alias("alone"), F.count_if(F.col("site").isNull()).alias("no_site"), F.count_if(~F.col("shape").contains(",")).alias("one_kind"))
    return got.collect()[0].asDict()


def main() -> None:
    from pyspark.sql import SparkSession

    from blockloom.tables import prepare

    spark = prepare(SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    for root in sys.argv[1:]:
        start = time.time()
        print(root, "alignment", alignment(spark, root), round(time.time() - start), "s", flush=True)


if __name__ == "__main__":
    main()
