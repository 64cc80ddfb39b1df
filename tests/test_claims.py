"""Findings, conclusions and report text."""

import random

from pyspark.sql import functions as F

from filingmill import schemas
from filingmill.functions import text as T
from filingmill.operators import conclusions as K
from filingmill.operators import qa, report, views
from filingmill.plans import flows


def finding(pos, **over):
    row = dict(
        company_id="c", document_id="d", finding_pos=pos, finding_id=f"f{pos}",
        specialist="s", report_section="business_overview", research_question="q",
        fact="Sales rose", data_points=[], calculations=[],
        analysis="The order book moved because of larger single orders.",
        investor_implication="Watch the next order intake.", classification="FACT",
        confidence="HIGH", accounting_basis="CONSOLIDATED", period="FY25",
        citations=[(3, 4, 5, "Chunk 3")], supporting_quote="Sales rose",
        insufficient_evidence=False, insufficient_reason=None,
    )
    row.update(over)
    return row


def findings(spark, rows):
    names = [f.split(" ")[0] for f in schemas.FINDINGS.split(", ")]
    frame = spark.createDataFrame([], schemas.FINDINGS)
    fields = frame.schema.names
    assert set(names) >= set(fields[:3])
    return spark.createDataFrame([tuple(r[n] for n in fields) for r in rows], schemas.FINDINGS)


def calculation(metric, result, bases=("CONSOLIDATED",), period="FY25"):
    inputs = [("a", 1.0, None, period, b) for b in bases]
    return (metric, inputs, "a", result, "1", period)


def test_grounding_and_support(spark):
    rows = [
        finding(0, fact="rose to 500", supporting_quote="500 units"),
        finding(1, supporting_quote=""),
        finding(2, fact="rose to 500", supporting_quote="50 units"),
        finding(3, citations=[]),
        finding(4, analysis="0123456789", investor_implication="01234"),
        finding(5, supporting_quote="", insufficient_evidence=True, citations=[]),
        finding(6, calculations=[calculation("m", 1.0, ("CONSOLIDATED", "STANDALONE"))]),
    ]
    notes = {(r.finding_id, r.status, r.severity) for r in qa.finding_notes(findings(spark, rows)).collect()}
    assert notes == {
        ("f1", "MISSING_EVIDENCE", "HIGH"), ("f2", "NUMERICAL_MISMATCH", "HIGH"),
        ("f3", "UNSUPPORTED_CONCLUSION", "HIGH"), ("f4", "UNSUPPORTED_CONCLUSION", "MEDIUM"),
        ("f6", "BASIS_MIXED", "HIGH"), ("f6", "NUMERICAL_MISMATCH", "MEDIUM"),
    }


def test_contradictions(spark):
    rows = [
        finding(0, calculations=[calculation("Margin", 100.0)]),
        finding(1, calculations=[calculation("margin", 106.0)]),
        finding(2, calculations=[calculation("Other", 100.0)]),
        finding(3, calculations=[calculation("Other", 105.0)]),
        finding(4, calculations=[calculation("margin", 100.0, ("STANDALONE",))]),
    ]
    notes = qa.contradiction_notes(findings(spark, rows)).collect()
    assert [(n.finding_id, n.severity) for n in notes] == [("f0", "MEDIUM")]
    assert notes[0].detail.endswith("100.00 vs 106.00")


def test_contradicted_results_match_a_loop(spark):
    rng = random.Random(2)
    rows = [(str(rng.randrange(6)), i, rng.choice([0.0, 1.0, 1.04, 1.06, -1.0, 1e-6, 50.0, 52.0])) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, pos bigint, value double")
    want = set()
    for k, i, a in rows:
        for k2, j, b in rows:
            if k == k2 and j > i and abs(a - b) / max(abs(a), abs(b), 1e-4) > 0.05:
                want.add(i)
    got = {r.pos for r in qa.contradicted_results(frame, ["k"], "pos").collect()}
    assert got == want


def test_summary_counts(spark):
    frame = findings(spark, [finding(0), finding(1), finding(2)])
    note = "company_id string, document_id string, finding_id string, status string, detail string, severity string"
    notes = spark.createDataFrame(
        [("c", "d", "f0", "A", "", "HIGH"), ("c", "d", "f0", "B", "", "HIGH"), ("c", "d", "f1", "C", "", "MEDIUM")], note
    )
    missing = spark.createDataFrame([("c", "d", "s", "q9")], "company_id string, document_id string, specialist string, question_id string")
    r = qa.qa_summary(frame, notes, missing).collect()[0]
    assert (r.total_findings, r.failed, r.passed, r.n_notes) == (3, 1, 2, 3)
    assert r.missing_questions == ["s:q9"]


def test_recorded_run_totals(spark):
    counts = {
        "business_industry": (11, 0), "financial": (10, 0), "cashflow_balance": (11, 0),
        "management_strategy": (7, 2), "rpt_governance": (11, 3), "auditor_accounting": (8, 0),
        "risks_catalysts": (10, 0),
    }
    rows, failed = [], 0
    for name, (n, insufficient) in counts.items():
        for i in range(n):
            low = i < min(insufficient, 2)
            bad = not low and failed < 25
            failed += bad
            rows.append(finding(len(rows), specialist=name, insufficient_evidence=low, citations=[] if bad else [(1, 1, 1, "x")]))
    out = flows.validate_findings(findings(spark, rows))
    r = out["summary"].collect()[0]
    assert (r.total_findings, r.passed, r.failed) == (68, 43, 25)
    totals = qa.run_totals(findings(spark, rows), ["document_id"]).collect()[0]
    assert (totals.n_findings, totals.n_supported) == (68, 64)


PACK = (
    "company_id string, document_id string, section_key string, unit_id string, chunk_index int, "
    "page_start int, page_end int, line_start int, line_end int, content string"
)


def packs(spark):
    return spark.createDataFrame(
        [
            ("c", "d", "financial", "4:1-1", 4, 7, 7, 1, 1, "Group revenue grew to 500 crore over the whole year"),
            ("c", "d", "financial", "4:2-2", 4, 7, 7, 2, 2, "Second line of the fourth chunk"),
            ("c", "d", "financial", "5:1-1", 5, 8, 9, 1, 1, "Revenue of 700 crore"),
        ],
        PACK,
    )


def test_cited_units(spark):
    cited = spark.createDataFrame(
        [("f1", "c", "d", "financial", ["5:1-1", "chunk 4", "none"]), ("f2", "c", "d", "financial", ["77"])],
        "finding_id string, company_id string, document_id string, section_key string, evidence_ids array<string>",
    )
    units = qa.cited_units(cited, packs(spark), ["finding_id"])
    out = {r.finding_id: r for r in qa.citations(units, ["finding_id"]).collect()}
    assert list(out) == ["f1"]
    assert [c.chunk_index for c in out["f1"].citations] == [4, 5]
    assert out["f1"].excerpt.startswith("Revenue of 700 crore \n Group revenue")


def test_quote_fallback(spark):
    quotes = spark.createDataFrame(
        [("f1", "c", "d", "evenue grew to 500 crore over the whole ye"), ("f2", "c", "d", "too short"), ("f3", "c", "d", "x" * 60)],
        "finding_id string, company_id string, document_id string, supporting_quote string",
    )
    rows = qa.quote_fallback(quotes, packs(spark), ["finding_id"]).collect()
    assert [(r.finding_id, r.unit_id) for r in rows] == [("f1", "4:1-1")]


def conclusion(pos, claim, ids, **over):
    row = dict(classification="FACT", confidence="HIGH", accounting_basis="CONSOLIDATED", figure=True)
    row.update(over)
    return ("c", "d", "financial", pos, claim, row["classification"], row["confidence"], row["accounting_basis"], row["figure"], ids)


def test_admission_ladder(spark):
    good = "Group revenue grew to 500 crore over the whole year"
    rows = [
        conclusion(1, good, ["4:1-1"]),
        conclusion(2, "", ["4:1-1"]),
        conclusion(3, good, ["9:9-9"]),
        conclusion(4, "Group revenue grew to 900 crore over the year", ["4:1-1"]),
        conclusion(5, "Second line fourth chunk", ["4:2-2"], figure=False, accounting_basis="NOT_APPLICABLE"),
        conclusion(6, good, ["4:1-1"], accounting_basis="STANDALONE"),
        conclusion(7, "Robust " + good, ["4:1-1"]),
        conclusion(8, "No data on taxes", [], classification="UNCERTAIN", figure=False, accounting_basis="NOT_APPLICABLE"),
        conclusion(9, "Revenue of 700 crore", ["5:1-1"]),
    ]
    frame = spark.createDataFrame(rows, schemas.CONCLUSIONS)
    chunks = spark.createDataFrame(
        [("c", "d", 4, "the Group results"), ("c", "d", 5, "no basis here")],
        "company_id string, document_id string, chunk_index int, content string",
    )
    judged = {r.pos: r for r in K.judge_conclusions(frame, packs(spark), chunks).collect()}
    assert {p: r.reject_reason for p, r in judged.items()} == {
        1: None, 2: "SCHEMA", 3: "NO_CITATION", 4: "NOT_SUPPORTED", 5: "OUT_OF_SCOPE",
        6: "BASIS_NOT_ESTABLISHED", 7: None, 8: None, 9: "BASIS_NOT_ESTABLISHED",
    }
    assert (judged[7].classification, judged[7].confidence) == ("INFERENCE", "MEDIUM")
    assert judged[1].data_point.startswith("Group revenue")
    assert [c.chunk_index for c in judged[1].citations] == [4]
    out = flows.validate_conclusions(frame, packs(spark), chunks)
    assert sorted(r.conclusion_id for r in out["accepted"].collect()) == ["financial-1", "financial-2", "financial-3"]
    assert out["status"].collect()[0].status == "COMPLETE"


def test_shortest_excerpt(spark):
    text = "alpha one\n\nbeta two\ngamma alpha\nbeta\n"
    rows = spark.createDataFrame([(text,), ("beta only",), ("x" * 300 + " alpha beta",)], "t string")
    got = [r.e for r in rows.select(K.shortest_excerpt(F.col("t"), ["(?i)ALPHA", "beta"]).alias("e")).collect()]
    assert got[0] == "gamma alpha beta" and got[1] is None
    assert got[2] == "x" * 179 + " alpha beta"


CLAIM = "company_id string, document_id string, section_key string, pos bigint, claim string, classification string"


def loop_merge(section, anchors, claims):
    """The merge rule as a plain loop."""
    import re

    def numbers(t):
        return [x.replace(",", "") for x in re.findall(r"\d[\d,]*", t)]

    def words(t):
        return list(dict.fromkeys(w for w in re.sub(r"\W+", " ", t.lower()).split() if len(w) > 3))

    merged = list(anchors)
    if not (anchors and section == "governance"):
        for c in claims:
            if c[1] == "UNCERTAIN" and anchors:
                continue
            held = any(numbers(m[0]) and all(n in numbers(c[0]) for n in numbers(m[0])) for m in merged)
            if not held:
                merged.append(c)
    if section == "risks":
        out = []
        for i, c in enumerate(merged):
            w = words(c[0])
            if not any(
                w and words(e[0]) and len([x for x in w if x in words(e[0])]) / min(len(w), len(words(e[0]))) >= 0.68
                for e in merged[:i]
            ):
                out.append(c)
        merged = out
    return [c[0] for c in merged[:5]]


def test_merge_matches_a_loop(spark):
    rng = random.Random(9)
    vocabulary = ["alpha", "bravo", "charlie", "delta", "echos", "10", "20", "30"]
    a_rows, c_rows, want = [], [], {}
    for d in range(60):
        section = rng.choice(["risks", "governance", "financial"])

        def make(n):
            return [
                (" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))), rng.choice(["FACT", "FACT", "UNCERTAIN"]))
                for _ in range(n)
            ]

        anchors, claims = make(rng.choice([0, 0, 1, 2])), make(rng.randrange(1, 8))
        a_rows += [("c", f"d{d}", section, i, t, k) for i, (t, k) in enumerate(anchors)]
        c_rows += [("c", f"d{d}", section, i, t, k) for i, (t, k) in enumerate(claims)]
        want[f"d{d}"] = loop_merge(section, anchors, claims)
    out = K.merge_claims(spark.createDataFrame(a_rows, CLAIM), spark.createDataFrame(c_rows, CLAIM))
    got = {f"d{d}": [] for d in range(60)}
    for r in sorted(out.collect(), key=lambda r: int(r.conclusion_id.split("-")[1])):
        got[r.document_id].append(r.claim)
    assert got == want


def test_summary_items(spark):
    cite = [(1, 2, 2, "Chunk 1")]
    rows = [
        ("c", "d", "financial", 1, "financial-1", "Revenue was 500 crore", "FACT", "HIGH", True, "CONSOLIDATED", cite),
        ("c", "d", "business", 1, "business-1", "Retail grew", "FACT", "LOW", False, "NOT_APPLICABLE", cite),
        ("c", "d", "risks", 1, "risks-1", "Open", "UNCERTAIN", "LOW", False, "NOT_APPLICABLE", []),
    ]
    conclusions = spark.createDataFrame(
        rows,
        "company_id string, document_id string, section_key string, pos int, conclusion_id string, claim string, "
        f"classification string, confidence string, financial_figure boolean, accounting_basis string, citations array<{schemas.CITATION}>",
    )
    items = spark.createDataFrame(
        [
            ("c", "d", "whatIsHappening", "Sales hit 500 crore", ["financial-1", "zz"]),
            ("c", "d", "biggestPositive", "Sales hit 900 crore", ["business-1"]),
            ("c", "d", "biggestConcern", "", []),
            ("c", "d", "whatMattersMost", "Retail is good", ["business-1"]),
        ],
        "company_id string, document_id string, item_key string, text string, source_ids array<string>",
    )
    out = {r.item_key: r for r in K.resolve_summary(items, conclusions).collect()}
    assert out["whatIsHappening"].text == "Revenue was 500 crore"
    assert out["whatIsHappening"].labels.accounting_basis == "CONSOLIDATED"
    assert (out["biggestPositive"].text, out["biggestPositive"].source_ids) == ("Retail grew", ["business-1"])
    assert out["biggestPositive"].labels.confidence == "LOW"
    assert out["biggestConcern"].text.startswith("The annual report evidence was insufficient")
    assert out["biggestConcern"].labels.classification == "UNCERTAIN"
    assert out["whatMattersMost"].text == "Retail is good"


def test_report_round_trip(spark):
    frame = findings(spark, [finding(0, fact="A [F1]"), finding(1, fact="B"), finding(2, insufficient_evidence=True)])
    narratives = spark.createDataFrame(
        [("c", "d", "business_overview", "Story (sourceFindingIds: [a])", ['{"headers":["h"],"rows":[["1"]]}'])],
        "company_id string, document_id string, report_section string, narrative string, tables array<string>",
    )
    documents = spark.createDataFrame([("c", "d", "AR", None, None)], "company_id string, document_id string, title string, publication_date date, document_date date")
    out = flows.assemble_report(frame, documents, narratives)
    research = out["research"]
    assert research.collect()[0].content.startswith("Story\n\n[TABLE]{")
    blocks = report.parse_section(research, ["report_section"]).orderBy("block_pos").collect()
    assert [b.kind for b in blocks] == ["narrative", "table", "findings"]
    assert blocks[2].text.startswith("A\nAnalysis:") and blocks[1].table.headers == ["h"]
    evidence = out["evidence"].orderBy("finding_id").collect()
    assert evidence[0].supporting_source == "AR, page 4-5, chunk 3; CONSOLIDATED basis"
    assert len(evidence) == 2


def test_conclusion_text(spark):
    rows = spark.createDataFrame([([(3, 4, 4, "x"), (5, 6, 7, "y")],)], f"c array<{schemas.CITATION}>")
    text = report.conclusion_text(
        F.lit("Claim"), F.lit("FACT"), F.lit("HIGH"), F.lit(True), F.lit("CONSOLIDATED"), F.col("c")
    )
    assert rows.select(text.alias("t")).collect()[0].t == (
        "Claim\n[Fact · high confidence · consolidated | Annual Report p. 4, 6-7 · chunks 3, 5]"
    )


def test_search_keeps_first_occurrence(spark):
    rows = spark.createDataFrame(
        [("1", "Abc one", "X", "N", ""), ("2", "Abc two", "ABC", "N", ""), ("3", "Zed", "abcd", "N", "")],
        "company_id string, name string, ticker string, exchange string, short_description string",
    )
    assert [r.company_id for r in views.search_companies(rows, "abc").collect()] == ["1", "2", "3"]
    assert views.search_companies(rows, " %* ").count() == 0


def test_kept_calculations(spark):
    rows = spark.createDataFrame(
        [([calculation("a", 1.0), ("b", [("x", 1234.4, None, "p", "STANDALONE")], "f", 2.0, "2", "p"), ("c", [], "f", 2.0, "2", "p")], "had 1 and 1,234 units")],
        f"calculations array<{schemas.CALCULATION}>, excerpt string",
    )
    kept = rows.select(qa.kept_calculations(F.col("calculations"), F.col("excerpt")).alias("k")).collect()[0].k
    assert [k.metric for k in kept] == ["a", "b"]


def test_fact_grounded(spark):
    rows = spark.createDataFrame(
        [("Sales grew strongly to 500", "strongly sales grew 500"), ("Sales grew to 500", "nothing 500"), ("It is so", "whatever")],
        "f string, e string",
    )
    none = F.array().cast("array<string>")
    got = [r.g for r in rows.select(T.fact_grounded(F.col("f"), none, F.col("e")).alias("g")).collect()]
    assert got == [True, False, True]


def test_best_excerpt_reads_a_claim_once(spark):
    """Words and numbers of a claim are found below the join with its units."""
    claims = spark.createDataFrame(
        [(1, "Jio Platforms earned 1,250 crore profit this quarter"), (2, "margins improved sharply during winter"), (3, None), (4, "")],
        "id int, claim string",
    )
    units = spark.createDataFrame(
        [(1, 1, "profit this quarter earned 1250 crore"), (1, 2, "Jio Platforms earned 1250 crore profit this quarter"),
         (2, 1, "Margins improved sharply in winter, during snow"), (2, 2, "margins improved"), (3, 1, "text"), (4, 1, "any")],
        "id int, cite_pos int, content string",
    )
    out = K.best_excerpt(claims, units, ["id"])
    got = {r.id: (r.excerpt, r.excerpt_score) for r in out.collect()}
    assert got == {
        1: ("Jio Platforms earned 1250 crore profit this quarter", 19),
        2: ("Margins improved sharply in winter, during snow", 15), 4: ("any", 0),
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert r"[^\p{L}\p{N}]+" in plan.split("Join Inner")[1] and r"[^\p{L}\p{N}]+" not in plan.split("Join Inner")[0]
