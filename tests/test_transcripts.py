"""Transcripts of each house style."""

import pytest

from siltstone.operators import transcripts

PAGES = {
    "classes": """<p class="TimeLine">The House met at 1:34 p.m.</p><p class="SpeakerName"><a href="#x">J. Tall</a></p>
<p class="Proceedings-Heading">Routine Business</p><p class="SubjectHeading">Bill 4</p><p class="TimeStamp" id="t1"><b>[1:35 p.m.]</b></p>
<p class="SpeakerBegins"><a name="101"></a><span class="Attribution">J. Tall: </span>First words.</p><p class="SpeakerContinues">More &eacute; words.</p>
<p class="EditorialComment">[Applause.]</p><p class="SpeakerBegins">without a label</p><blockquote class="Quote">A quote.</blockquote>
<p class="Business-Heading">Orders</p><p class="SpeakerContinues">nobody's</p><p class="SpeakerBegins">Hon. B. Low (Deputy Speaker): Order.</p><p class="SpeakerBegins">C. Empty:</p>""",
    "linked names": """<h2>GOVERNMENT NOTICES</h2><p><a name="tall-1"></a><a href="/members/profiles/tall" class="hsd_mla" title="View Profile">HON. ANN TALL</a> <a href="#p">Previous</a> : Thank you.</p>
<p>Second paragraph.</p><blockquote>Whereas;</blockquote><p><a href="/members/speaker/" class="hsd_mla">THE SPEAKER</a> : Order.</p>""",
    "speaker starts": """<h3>Orders of the Day</h3><p class="speakerStart"><span id="para49"/><strong>Hon. Eve Daman (Lieutenant Governor):</strong> Please sit.</p><p class="procedure">All rose.</p>
<p class="timeStamp">1040</p><p class="timeStamp">10:40</p><p class="speakerStart"><strong>Mr. Sam Clay:</strong> Yes: <strong>indeed</strong>.</p><p>And so on.</p>""",
    "word 97": """<HTML><HEAD><META NAME="Generator" CONTENT="Microsoft Word 97"><TITLE>x</TITLE></HEAD><BODY><P ALIGN="CENTER">ROUTINE PROCEEDINGS</P>
<B><P ALIGN="JUSTIFY">Hon. Gil Sand (Minister of
Finance): </B>Mr. Speaker, I table it.</P><P ALIGN="JUSTIFY">&#9;Also this.</P><B><P>Mr. Speaker: </B>Order.</P></BODY></HTML>""",
    "front page": """<html><head><meta name="GENERATOR" content="Microsoft FrontPage 3.0"></head><body><p>&nbsp;<b></p>
<p>MR. SPEAKER (Frost): </b>Order, please!</p><p>MR. MARTIN:</b> Thank you, Mr. Speaker.</p><p>Go on: he did.</p><p align="center">Petitions</p><p>SOME HON. MEMBERS:</b> Hear, hear!</p></body></html>""",
    "bold names": """<p class=MsoNormal align=center><b>ORAL QUESTIONS</b></p><p class=MsoNormal><b>*</b> (13:40)</p><p class=MsoNormal><b>Mr. Kane:</b> A question.</p><p class=MsoNormal>More of it.</p>
<p class=MsoNormal style="text-align: center"><b>Health Care</b></p><p class=MsoNormal><b><span>La Vice-Présidente (Mme&nbsp;Sorel)&nbsp;: </span></b>Merci <b>bien</b>.</p><p>(Applaudissements)</p>""",
    "printed": """Title: Monday
Mr. Early: not yet
head:

Members' Statements
The Speaker: Hon. members, let us
pray for the con-
tinued good.

Second paragraph.
Some Hansard
April 16, 2026
123
[Some applause]
MS SMITH-JONES: Thank you: all.
head: Orders of the Day
Hon. Members: Aye.
[The Assembly adjourned at 6 p.m.]
Mr. Index: 12""",
    "two languages": """LEGISLATIVE ASSEMBLY
13:05
Hon. Ms. Hale, Premier: We are here
and there.
L’hon. Mme Hale : Nous sommes ici.
Mr. Speaker: Order.
(Interjections)
17
Mr. D'Arcy: So be it.""",
}
WANT = {
    "classes": [("J. Tall", None, "First words.\nMore é words.\nwithout a label\nA quote.", "Routine Business", "Bill 4", "1:35 p.m.", "101"), ("Hon. B. Low", "Deputy Speaker", "Order.", "Orders", None, "1:35 p.m.", None)],
    "linked names": [("HON. ANN TALL", None, "Thank you.\nSecond paragraph.\nWhereas;", "GOVERNMENT NOTICES", None, None, "tall-1"), ("THE SPEAKER", None, "Order.", "GOVERNMENT NOTICES", None, None, None)],
    "speaker starts": [("Hon. Eve Daman", "Lieutenant Governor", "Please sit.\n1040", "Orders of the Day", None, None, "para49"), ("Mr. Sam Clay", None, "Yes: indeed.\nAnd so on.", "Orders of the Day", None, "10:40", None)],
    "word 97": [("Hon. Gil Sand", "Minister of Finance", "Mr. Speaker, I table it.\nAlso this.", "ROUTINE PROCEEDINGS", None, None, None), ("Mr. Speaker", None, "Order.", "ROUTINE PROCEEDINGS", None, None, None)],
    "front page": [("MR. SPEAKER", "Frost", "Order, please!", None, None, None, None), ("MR. MARTIN", None, "Thank you, Mr. Speaker.\nGo on: he did.", None, None, None, None), ("SOME HON. MEMBERS", None, "Hear, hear!", "Petitions", None, None, None)],
    "bold names": [("Mr. Kane", None, "A question.\nMore of it.", "ORAL QUESTIONS", None, "13:40", None), ("La Vice-Présidente", "Mme Sorel", "Merci bien.\n(Applaudissements)", "Health Care", None, "13:40", None)],
    "printed": [("The Speaker", None, "Hon. members, let us pray for the continued good.\nSecond paragraph.", "Members' Statements", None, None, None), ("MS SMITH-JONES", None, "Thank you: all.", "Members' Statements", None, None, None), ("Hon. Members", None, "Aye.", "Orders of the Day", None, None, None)],
    "two languages": [("Hon. Ms. Hale, Premier", None, "We are here and there. L’hon. Mme Hale : Nous sommes ici.", None, None, "13:05", None), ("Mr. Speaker", None, "Order.", None, None, "13:05", None), ("Mr. D'Arcy", None, "So be it.", None, None, "13:05", None)],
}


@pytest.mark.parametrize("name", PAGES)
def test_dialects(name):
    assert transcripts.dialect_of(PAGES[name]) == name
    assert [tuple(t) for t in transcripts.read_turns(PAGES[name])] == WANT[name]


def test_turns_of_many_pages(spark):
    rows = [(k, PAGES[n]) for k, n in enumerate(PAGES)] + [(100, None), (101, ""), (102, "no label here"), (103, "<p>no label here</p>")]
    found = transcripts.transcript_turns(spark.createDataFrame(rows, "id int, page string").repartition(3), "id", "page").collect()
    for k, n in enumerate(PAGES):
        own = sorted((r for r in found if r["id"] == k), key=lambda r: r["sequence"])
        assert [tuple(r)[2:9] for r in own] == WANT[n] and {r["dialect"] for r in own} == {n}
        assert [r["sequence"] for r in own] == list(range(len(own)))
    assert max(r["id"] for r in found) < 100


@pytest.mark.parametrize(("label", "is_one"), [("The Deputy Speaker", True), ("THE SERGEANT-AT-ARMS", True), ("Mr. Speaker", True), ("Some Hon. Members", True), ("Mr. Tall", True), ("Ms Low-Smith", True), ("Hon. Ms. Hale, Premier", True), ("The time", False), ("Mr.", False), ("He said", False), ("Member of the house for all of it there", False), ("", False)])
def test_labels_of_a_print(label, is_one):
    assert transcripts.printed_label(label) == is_one


def test_every_event_of_a_rule_is_in_the_table():
    known = {e for _, e in transcripts.TRANSITIONS} | {"note", "set apart"}
    for dialect in transcripts.DIALECTS.values():
        assert {r.event for r in dialect.rules} <= known | {e for _, e in dialect.transitions}


@pytest.mark.parametrize("html", ["", "<p", "<b><b><p>a:</b></b></b>x</p></p>", "<p><b>A:</b></p><p><b>B:</b> c<p>d<p>e", "<table><tr><td><b>X:</b> y</td></tr></table>", "<p>a<script>b: c</script>d</p>"])
def test_broken_pages_do_not_crash(html):
    for name in transcripts.DIALECTS:
        transcripts.read_turns(html, name)
