"""Stages of bills in each layout."""

import datetime as dt

from siltstone.operators import bills

PAGE = """<table><tr class="key"><td>First Reading</td><td></td></tr><tr><td>Royal Assent</td><td>&nbsp;</td></tr></table>
<table><tr class="odd"><td> First Reading </td><td>September 23, 2025 - <a href="x">Bill</a></td></tr><tr class="even"><td>Second Reading Debates</td><td><a>October 1, 2025</a></td></tr>
<tr><td>Second Reading</td><td>October 1, 2025</td></tr><tr><td>Private &amp; Local Bills</td><td>Oct. 2. 2025</td></tr><tr><td>Withdrawn</td><td></td></tr><tr><td>Sponsor</td><td>May 1, 2025</td></tr><tr><td>Royal Assent</td><td>February 30, 2025</td></tr></table>"""
DASHBOARD = """<a id="menu"></a><div class="b_entry b_x"><div class="b_date">May 1, 2020</div></div>
<a id="g12"></a><h2>Bill 1</h2><div class="b_entry b_1r"><span title="First Reading" class="reading r1r billgt">1R</span><div class="b_date">Mar 5, 2026</div><div class="b_status">passed</div></div>
<div class="b_entry b_cw"><span title="Committee of the Whole" class="reading rcw">CW</span><div class="b_date"></div><div class="b_status"></div></div><div class="b_entry b_none"><div class="b_date">May 1, 2020</div></div>
<a id="g7"></a><div class="b_entry b_zz"><span title="Something &amp; else" class="reading rzz">Z</span><div class="b_date">Apr 1, 2026</div></div>"""
PRINT = """Bill Status 2025-12
STATUS OF BILLS
12 The Example Act Hon. Mr. Tall
Nov. 18, 2025 Nov. 20, 2025
Social Development
Dec. 3. 2025
Dec. 3, 2025 Dec. 4, 2025
Royal
Assent
GOVERNMENT BILLS
13 A FORMAL BILL Nov. 18, 2025 Nov. 19, 2025
14 No dates here
lower 15 case
200 Another Act Mar. 4, 2026 Mar. 31, 2026 Apr. 1, 2026 Apr. 2, 2026 Apr. 3, 2026 Apr. 4, 2026 Apr. 5, 2026"""


def rows(found, *columns):
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)


def test_pages_of_one_bill(spark):
    found = bills.page_stages(spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>no table</p>")], "id int, html string"), "id")
    day = dt.date
    assert rows(found, "id", "sequence", "stage", "day") == sorted([(1, 0, "first_reading", day(2025, 9, 23)), (1, 1, "second_reading", day(2025, 10, 1)), (1, 2, "committee", day(2025, 10, 2)), (1, 3, "withdrawn", None)], key=repr)


def test_dashboards(spark):
    found = bills.dashboard_stages(spark.createDataFrame([(1, DASHBOARD), (2, None)], "id int, html string"), "id")
    assert rows(found, "bill", "sequence", "stage", "label", "day", "status") == sorted([("12", 0, "first_reading", "First Reading", dt.date(2026, 3, 5), "passed"), ("12", 1, "committee", "Committee of the Whole", None, None), ("7", 0, "other", "Something & else", dt.date(2026, 4, 1), None)], key=repr)


def test_printed_tables(spark):
    found = bills.printed_stages(spark.createDataFrame([(1, PRINT), (2, None), (3, "")], "id int, text string"), "id")
    got = rows(found, "bill", "sequence", "stage", "day")
    assert [g[1:] for g in got if g[0] == "12"] == [(0, "first_reading", dt.date(2025, 11, 18)), (1, "second_reading", dt.date(2025, 11, 20)), (2, "committee", dt.date(2025, 12, 3)), (3, "third_reading", dt.date(2025, 12, 4))]
    assert [g[1:] for g in got if g[0] == "13"] == [(0, "first_reading", dt.date(2025, 11, 18))]
    assert [g[2] for g in got if g[0] == "200"] == list(bills.COLUMNS) and {g[0] for g in got} == {"12", "13", "200"}
