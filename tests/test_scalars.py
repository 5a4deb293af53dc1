from parity import compare, connect

from tessera.plans import catalog

SF = "/root/testdata/sf0.01"


def test_case_of_whole_texts(spark):
    """Every character of a turn is lower- and upper-cased, however long it is."""
    sql = "SELECT conv_id, turn, lower(text) AS low, upper(replace(text, 'ß', 'ss')) AS up FROM conversations"
    con = connect(SF)
    assert con.sql("SELECT max(length(text)) FROM conversations").limit(1).fetchall()[0][0] > 200
    compare(catalog.QUERIES["case_functions"](spark, SF), con, sql)
