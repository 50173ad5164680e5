import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

BLOCKS = (
    "document_id string, block_id string, site string, block_type string, text string, table_data struct<caption:string,headers:array<string>,rows:array<array<string>>,notes:array<string>>,"
    "image struct<image_id:string,caption:string,ocr_text:string,image_path:string,width:double,height:double>, page_start int, page_end int, bbox array<double>, heading_path array<string>, heading_level int,"
    "page_height double, excluded_from_retrieval boolean, ocr_decision string, metadata string, source_trace struct<parser:string,raw_object_type:string,raw_object_index:int,raw_page_index:int,raw_sheet_name:string,raw_slide_index:int,raw_locator:string>,"
    "quality_flags array<string>, block_order int, received_at timestamp"
)
NAMES = [c.split()[0] for c in "document_id,block_id,site,block_type,text,table_data,image,page_start,page_end,bbox,heading_path,heading_level,page_height,excluded_from_retrieval,ocr_decision,metadata,source_trace,quality_flags,block_order,received_at".split(",")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from blockloom.tables import prepare

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield prepare(s)
    s.stop()


@pytest.fixture(scope="session")
def make_blocks(spark):
    def make(rows):
        """Blocks from dicts; what isn't named is null."""
        return spark.createDataFrame([tuple(r.get(c) for c in NAMES) for r in rows], BLOCKS)

    return make
