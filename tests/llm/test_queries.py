"""The registered queries on the smallest driver tables, against SQL where there is one."""

import glob
import os

import duckdb
import pytest

from paceline.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def keyed(frame):
    return sorted(map(tuple, frame[sorted(frame.columns)].astype(str).values.tolist()))


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, database, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), database.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and keyed(ours) == keyed(theirs)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op1_language_id"](spark, FOLDER).join(docs, "doc_id").collect()
    asked = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and asked
    assert sum(r.lang == r.lang_pred for r in asked) >= 0.95 * len(asked)


def test_pages_give_their_articles(spark, database):
    """Every page of the tables has one article element; its text is what is to be found."""
    import html
    import re

    texts = {r.page_id: r.text for r in QUERIES["op9_main_text"](spark, FOLDER).collect()}
    pages = database.execute("SELECT page_id, html FROM pages").fetchall()
    assert len(texts) == len(pages)
    for page_id, page in pages:
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", page)[1].split("<footer")[0]
        inner = re.sub(r"</?(?:b|a|i)(?:\s[^>]*)?>|<[^>]*\Z", "", inner)
        blocks = re.split(r"</?(?:p|h1|br|ul|li|div)[^>]*>", inner)
        plain = (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in blocks)
        assert texts[page_id] == " ".join(x for x in plain if x)


def test_rates_cover_all_documents(spark):
    rows = QUERIES["op8_mixing_rates"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.rate >= 0 for r in rows)
