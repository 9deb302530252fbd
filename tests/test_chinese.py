"""First pages of Chinese journals and emphasis on rows whose results are known."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import chinese


@pytest.mark.parametrize(("text", "title", "want"), [
    (None, "t", ([], None, None, None)), (" \n", None, ([], None, None, None)),
    ("第 48 卷 石油学报 2021 年 3 月\n页岩评价\n王小明1，李四2\n（1. 大学）", "页岩评价", (["王小明", "李四"], "石油学报", "2021", None)),
    ("页岩评价\n王小明，作者简介，李四和赵云；摘要：王五", "页岩评价", (["王小明"], None, None, None)),
    ("王小明，李四，张三丰 10.1234/ABC.2019.7", None, (["王小明", "李四", "张三丰"], None, "2019", "10.1234/abc.2019.7")),
    ("文章编号：1000-0747(2018)1 10.1234/x2020", "缺席", ([], None, "2018", "10.1234/x2020")),
    ("plain text without any", "", ([], None, None, None))])
def test_first_page(spark, text, title, want):
    df = spark.createDataFrame([(text, title)], "t string, n string")
    got = df.select(chinese.first_page(F.col("t"), F.col("n")).alias("m")).first().m
    assert (got.authors, got.journal, got.year, got.doi) == want


def test_emphasis(spark):
    cases = {"**“a”**b": "<strong>“a”</strong>b", "**b** *（c）* d*": "**b** <em>（c）</em> d*", "***（x）***": "<strong><em>（x）</em></strong>", "~~a。~~": "<del>a。</del>", "** “a”**": "<em>* “a”</em>*",
             "*a\n。*": "*a\n。*", "": "", None: None, "__“__": "<strong>“</strong>", "plain": "plain"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", chinese.emphasised(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in rows} == cases
