from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siteloom.session import session

    s = session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


PAGE = "page_id long, site string, url string, final_url string, status int, content_type string, html string, headers map<string,string>, error string, redirect_chain array<string>, from_sitemap boolean, from_probe boolean, from_citation boolean, crawl_idx int"


@pytest.fixture(scope="session")
def pages(spark):
    """Builds archive rows from dicts; what is not given is what a good page has."""

    def build(*rows):
        names = [c.split()[0] for c in PAGE.replace("map<string,string>", "m").split(", ")]
        out = []
        for k, row in enumerate(rows):
            base = {"page_id": k, "site": "a.com", "url": f"https://a.com/{k}", "status": 200, "content_type": "text/html", "crawl_idx": k, "from_sitemap": False, "from_probe": False, "from_citation": False}
            base |= row
            base.setdefault("final_url", base["url"])
            out.append(tuple(base.get(n) for n in names))
        return spark.createDataFrame(out, PAGE)

    return build


@pytest.fixture(scope="session")
def data():
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test data")
    return str(folder)
