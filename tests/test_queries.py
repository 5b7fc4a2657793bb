"""Every query of the library (without the training-data operators) against its SQL, or for its rows."""

import pytest

from tidemark.plans import catalog, estate

from .compare import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(con, ORACLE[name])


#: Rows of the jobs that rest on sequence ratios, which SQL does not have; their operators are tested by themselves.
RATIOS = {"jn_fuzzy_title": 1, "jn_skeleton_fuzzy": 50, "jn_pair_diff": 1, "sc_claim_match": 40, "sc_shortlist": 1}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert len(spark_rows(QUERIES[name](spark, SF))[1]) >= RATIOS[name]


def test_mentions_are_whole_words_of_any_script(spark, con):
    said = [(1, "que les"), (2, "èque les"), (3, "queü les, que"), (4, "leś que"), (5, "the_that with"), (6, "die-der"), (7, None)]
    rows = [(c, 0, "user", text) for c, text in said]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").createOrReplaceTempView("said")
    own = con.cursor()
    own.execute("CREATE SCHEMA said; CREATE TABLE said.conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR); SET search_path = 'said'")
    own.executemany("INSERT INTO said.conversations VALUES (?, ?, ?, ?)", rows)

    class Said:
        messages = spark.sql("SELECT conv_id AS thread_id, turn AS seq, role, text AS content FROM said")

    got = spark_rows(estate.ag_comention_pairs(Said))
    assert got == duck_rows(own, ORACLE["ag_comention_pairs"])
    assert got[1] == [("der", "die", "1"), ("les", "que", "2")]
