from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given
from hypothesis import strategies as st

from receiptlake.functions.instants import moment
from receiptlake.operators import timestamps

NY, KL = "America/New_York", "Asia/Kuala_Lumpur"
CASES = [
    ("15/10/2016", KL, "dmy", "2016-10-15"), ("05/24/2018 18:57:20+00:00", NY, "mdy", "2018-05-24T18:57:20.000Z"), ("20190105", KL, "dmy", "2019-01-05"), ("1453872840", KL, "dmy", "2016-01-27T05:34:00.000Z"), ("1560780120000", KL, "dmy", "2019-06-17T14:02:00.000Z"),
    ("1461533945.0", KL, "dmy", "2016-04-24T21:39:05.000Z"), ("Mon, 25 Sep 2023 13:36", "Europe/London", "dmy", "2023-09-25T12:36:00.000Z"), ("28 Feb '21", KL, "dmy", "2021-02-28"), ("22 OGOS 2017", KL, "dmy", "2017-08-22"), ("3:19:52 PM GMT+7 20190323", NY, "mdy", "2019-03-23T08:19:52.000Z"),
    ("2018-11-20T05:27:30.327310", KL, "dmy", "2018-11-19T21:27:30.327Z"), ("2023-02-04T21:50[Europe/London]", KL, "dmy", "2023-02-04T21:50:00.000Z"), ("2021-11-23T09:11:30 GMT+5:30", KL, "dmy", "2021-11-23T03:41:30.000Z"), ("TARIKH 2021-06-15", KL, "dmy", "2021-06-15"), ("15/05/2016 08h39", KL, "dmy", "2016-05-15T00:39:00.000Z"),
    ("31/06/2022", KL, "dmy", None), ("15 Mar", KL, "dmy", None), ("??/??/20??", KL, "dmy", None), ("n/a", KL, "dmy", None), ("", KL, "dmy", None), (None, KL, "dmy", None), ("2020-01-01 10:00", None, "dmy", None), ("2020-01-01 10:00Z", None, None, "2020-01-01T10:00:00.000Z"),
    ("2021-11-07 01:30", NY, "mdy", "2021-11-07T05:30:00.000Z"), ("2021-03-14 02:30", NY, "mdy", "2021-03-14T07:30:00.000Z"), ("11/03/2018 12:05am", NY, "mdy", "2018-11-03T04:05:00.000Z"), ("2019年3月4日 10:00", "UTC", "dmy", "2019-03-04T10:00:00.000Z"),
]


@pytest.mark.parametrize(("text", "zone", "order", "wanted"), CASES)
def test_moments(text, zone, order, wanted):
    assert moment(text, zone, order) == wanted


@given(st.datetimes(datetime(1990, 1, 1), datetime(2035, 1, 1)), st.sampled_from([NY, KL, "Australia/Sydney", "Europe/London"]))
def test_any_local_time_is_placed(t, zone):
    want = t.replace(microsecond=0, tzinfo=ZoneInfo(zone)).astimezone(UTC)
    assert moment(t.strftime("%d/%m/%Y %H:%M:%S"), zone, "dmy") == want.strftime("%Y-%m-%dT%H:%M:%S.000Z")


def test_dictionary_only_parses_what_is_new(spark, tmp_path):
    prof = spark.createDataFrame([("A", KL, "dmy"), ("B", NY, "mdy")], "source string, tz_name string, date_order string")
    rows = spark.createDataFrame([(1, "01/02/2020", "A"), (2, "01/02/2020", "B"), (3, "01/02/2020", "A"), (4, None, "A"), (5, " ", "A"), (6, "x", "A"), (7, "01/02/2020", None)], "row_id long, date string, source string")
    path = str(tmp_path / "book")
    got = {tuple(r) for r in timestamps.normalise_moments([("t", rows, "row_id", "date", "source")], prof, path).collect()}
    assert got == {("t", 1, "2020-02-01"), ("t", 2, "2020-01-02"), ("t", 3, "2020-02-01"), ("t", 7, "2020-02-01")}
    book = timestamps.MomentDictionary(spark, path)
    n = book.table().count()
    again = timestamps.normalise_moments([("t", rows.union(spark.createDataFrame([(8, "03/04/2021", "B")], rows.schema)), "row_id", "date", "source")], prof, path)
    assert ("t", 8, "2021-03-04") in {tuple(r) for r in again.collect()}
    assert book.table().count() == n + 1
    assert timestamps.normalise_moments([("t", rows.limit(0), "row_id", "date", "source")], prof).count() == 0


def test_two_writers_leave_one_entry_a_key(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("01/02/2020", KL, "dmy"), ("x", None, None)], "raw string, tz_name string, date_order string")
    a, b = timestamps.MomentDictionary(spark, str(tmp_path / "book")), timestamps.MomentDictionary(spark, str(tmp_path / "book"))
    publish = b._publish

    def late(written, number):
        if number == 0:
            a.learn(rows)  # the other writer comes first
        return publish(written, number)

    monkeypatch.setattr(b, "_publish", late)
    b.learn(rows.union(spark.createDataFrame([("02/02/2020", KL, "dmy")], rows.schema)))
    assert sorted(r.raw for r in b.table().collect()) == ["01/02/2020", "02/02/2020", "x"] and len(b.batches()) == 2
    assert {tuple(r) for r in b.resolve(rows).collect()} == {("01/02/2020", KL, "dmy", "2020-02-01")}
