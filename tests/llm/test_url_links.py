"""Which links make two urls one page."""

import pytest
from pyspark.sql import functions as F

from glimmer.llm import url_filters

RULES = [("block", "x.net/")]

LINKED = {
    "url without a path": ("http://b.com", '<link rel="canonical" href="http://x.net">'),
    "rel of several words": ("http://b.com/1", '<link rel="nofollow canonical" href="http://x.net/">'),
    "attributes in any order, in any case": ("http://b.com/2", "<LINK HREF='http://x.net/' REL=Canonical >"),
    "spaces around the value": ("http://b.com/3", '<link rel=canonical href=" http://x.net/ ">'),
    "the scheme's own port": ("http://b.com/4", '<link rel=canonical href="http://x.net:80/">'),
    "the other scheme's own port": ("http://b.com/5", '<link rel=canonical href="HTTPS://x.net:443/">'),
    "a user": ("http://b.com/6", '<link rel=canonical href="http://me:pw@x.net/">'),
    "a fragment": ("http://b.com/7", '<link rel=canonical href="http://X.net/#top">'),
    "a base": ("http://b.com/8", '<base target=_top><base href="http://x.net/"><link rel=canonical href="">' + '<meta http-equiv=refresh content="1;url=/">'),
    "a relative base": ("http://x.net/y/z", '<base href="../"><link rel=canonical href="http://b.com/base">'),
    "refresh without url=": ("http://b.com/9", '<meta http-equiv="refresh" content="0; http://x.net/">'),
    "refresh with a comma and quotes": ("http://b.com/10", "<meta content=\"0, URL = 'http://x.net/'\" http-equiv=refresh>"),
    "the second link": ("http://b.com/11", '<link rel=canonical href="http://c.com/"><link rel=canonical href="http://x.net/">'),
    "the second refresh": ("http://b.com/12", '<meta http-equiv=refresh content="5"><meta http-equiv=refresh content="9;url=//x.net">'),
    "character references": ("http://b.com/13", '<link rel=canonical href="http&#58;//x.net/&#x3f;&amp;">'),
}
APART = {
    "another port": ("http://b.com/20", '<link rel=canonical href="http://x.net:8080/">'),
    "another relation": ("http://b.com/21", '<link rel="stylesheet" href="http://x.net/" title="canonical">'),
    "refresh of the page itself": ("http://b.com/22", '<meta http-equiv=refresh content="30"> canonical http://x.net/'),
    "another attribute's name": ("http://b.com/23", '<link rel=canonical data-href="http://x.net/">'),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [("http://x.net/", ""), *LINKED.values(), *APART.values(), ("http://x.net/?&", ""), ("http://x.net/y/z", "")]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    found = url_filters.judge(pages, RULES).join(pages.withColumnRenamed("page_id", "id"), "id").collect()
    return {r["url"]: r["verdict"] for r in found}


@pytest.mark.parametrize("case", sorted(LINKED))
def test_linked(verdicts, case):
    assert verdicts[LINKED[case][0]] == "block"


@pytest.mark.parametrize("case", sorted(APART))
def test_apart(verdicts, case):
    assert verdicts[APART[case][0]] == "allow"


def test_plan_stays_small(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "")], "page_id long, url string, html string")
    edges = url_filters.link_edges(pages, "url", "html")
    assert len(edges._jdf.queryExecution().executedPlan().toString()) < 40_000
    assert len(edges._jdf.queryExecution().optimizedPlan().treeString()) < 80_000


def test_many_open_tags_take_linear_time(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "<link " * 100_000 + "canonical")], "page_id long, url string, html string")
    assert url_filters.link_edges(pages.where(F.col("page_id") > 0), "url", "html").count() == 0
