"""XML forms as hand-made texts."""

import datetime as dt

from barflow.operators import filings as g

AT = dt.datetime(2022, 5, 1)


def forms(spark, xml):
    return spark.createDataFrame([("1", "A", AT, xml)], "accession string, symbol string, accepted_at timestamp, content string")


def test_insider_transactions_are_shared_among_owners(spark):
    xml = "<d><reportingOwner><id><rptOwnerCik>11</rptOwnerCik></id></reportingOwner><reportingOwner><id><rptOwnerCik>12</rptOwnerCik></id></reportingOwner><nonDerivativeTransaction><transactionDate><value>2022-04-30</value></transactionDate><c><transactionCode>P</transactionCode></c><a><transactionShares><value>1,000</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare></a></nonDerivativeTransaction></d>"
    got = g.transactions_xml(forms(spark, xml)).collect()
    assert {(r.person_cik, r.transaction_code, r.shares, r.value_usd) for r in got} == {("11", "P", 500.0, 1250.0), ("12", "P", 500.0, 1250.0)}


def test_holdings_notices_and_owners(spark):
    h = g.holdings_xml(forms(spark, "<x><infoTable><cusip>C1</cusip><value>5</value><s><sshPrnamt>7</sshPrnamt></s></infoTable></x>")).first()
    assert (h.cusip, h.value_usd, h.shares) == ("C1", 5000.0, 7.0)
    n = g.notices_xml(forms(spark, "<x><securitiesInformation><noOfUnitsSold>10</noOfUnitsSold><aggregateMarketValue>99</aggregateMarketValue><approxSaleDate>04/30/2022</approxSaleDate></securitiesInformation></x>")).first()
    assert (n.shares, n.value_usd, n.effective_at) == (10.0, 99.0, dt.date(2022, 4, 30))
    o = g.owners_xml(forms(spark, "<x><reportingPersonName>A</reportingPersonName><reportingPersonName>B</reportingPersonName><reportingPersonCIK>7</reportingPersonCIK><percentOfClass>5.5</percentOfClass><percentOfClass>6</percentOfClass></x>")).orderBy("k").collect()
    assert [(r.person_name, r.person_cik, r.percent_owned) for r in o] == [("A", "0000000007", 5.5), ("B", "0000000007", 6.0)]


def test_amendments_and_restatements(spark):
    f = spark.createDataFrame([("m", "p", "1", AT, None), ("m", "p", "2", AT + dt.timedelta(1), "RESTATEMENT"), ("m", "p", "3", AT + dt.timedelta(2), "NEW HOLDINGS")], "manager string, period string, accession string, accepted_at timestamp, amendment string")
    assert sorted(r.accession for r in g.effective_filings(f).collect()) == ["2", "3"]


def test_values_stay_with_their_transaction_and_namespaces_do_not_count(spark):
    t = "<nonDerivativeTransaction><transactionDate><value>2022-04-30</value></transactionDate><transactionCode>{}</transactionCode><transactionShares><value>{}</value></transactionShares>{}</nonDerivativeTransaction>"
    price = "<transactionPricePerShare><value>2</value></transactionPricePerShare>"
    xml = '<d xmlns="http://x/y"><reportingOwner><rptOwnerCik>11</rptOwnerCik></reportingOwner>' + t.format("G", 10, "") + t.format("P", 20, price) + "</d>"
    d = g.transactions_xml(forms(spark, xml))
    assert [(r.k, r.transaction_code, r.shares, r.price) for r in d.orderBy("k").collect()] == [(0, "G", 10.0, None), (1, "P", 20.0, 2.0)]
    assert g.transactions_xml(forms(spark, None)).unionByName(g.transactions_xml(forms(spark, "<a/>"))).count() == 0
    assert "xpath" not in d._jdf.queryExecution().toString()  # a text is parsed once, not for each path


def test_times_of_each_format(spark):
    d = spark.createDataFrame([("2022-04-30T01:02:03",), ("2022-04-30 01:02:03",), ("20220430010203",), ("2022-04-30",), ("04/30/2022",), ("x",), (None,)], "t string")
    one, two = dt.datetime(2022, 4, 30, 1, 2, 3), dt.datetime(2022, 4, 30)
    assert [r.x for r in d.select(g.parsed_time(d.t).cast("string").alias("x")).collect()] == [str(one)] * 3 + [str(two)] * 2 + [None] * 2
