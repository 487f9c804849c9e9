"""Normaliser, files and case JSON."""

import json

import pytest
from pyspark.sql import functions as F

from caseloom.functions import normalize
from caseloom.sources import casejson, reports
from caseloom.streaming import incremental  # noqa: F401

DRUGS = {
    "Lipitor 20 mg oral tablet": "atorvastatin", "atorvastatn": "atorvastatin", "metfomin": "metformin", "valsartan": "valsartan", "Diovan": "valsartan",
    "FORMOTEROL FUMARATE DIHYDRATE": "formoterol", "Clotrimazole Topical": "clotrimazole", "POTASSIUM CHLORIDE": "potassium chloride", "SODIUM CHLORIDE": "sodium chloride",
    "Calcium": "calcium", "FERROUS SULFATE": "ferrous sulfate", "LOSARTAN POTASSIUM": "losartan", "OMEPRAZOLE MAGNESIUM": "omeprazole",
    "ASPIRIN (ACETYLSALICYLIC ACID)": "aspirin", "LIPITOR (ATORVASTATIN CALCIUM)": "atorvastatin", "": "", "20 mg": "20 mg", "vitamin b12 1000mcg": "vitamin b12", "novel (lipitor)": "atorvastatin",
}
EVENTS = {
    "throwing up": "nausea", "Chronic obstructive pulmonary disease": "chronic obstructive pulmonary disease", "acute myocardial infarction": "acute myocardial infarction",
    "severe migraine": "headache", "Pollakiuria": "pollakiuria", "Haematemesis": "haematemesis", "AKI": "acute kidney injury", "Injection site pain": "injection site pain",
    "Blood calcium decreased": "blood calcium decreased", "can't sleep": "insomnia", "arthralga": "arthralgia", "...": "", "patient felt dizzy, then rash": "dizziness", "hives (urticaria)": "rash",
}


@pytest.mark.parametrize("kind, cases", [("drug", DRUGS), ("event", EVENTS)])
def test_terms(spark, kind, cases):
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r.raw: r.norm for r in normalize.normalized_terms(df, kind).collect()} == cases


def test_plain_text_functions(spark):
    row = spark.range(1).select(normalize.clean_text(F.lit("Severe, chronic  feeling of Pain")).alias("a"), normalize.clean_text(F.lit("Severe, chronic  feeling of Pain"), True).alias("b"), normalize.clean_drug_text(F.lit("Lipitor 20MG tab 5-fu b12 0.5 mL")).alias("c")).first()
    assert (row.a, row.b, row.c) == ("severe chronic feeling of pain", "of pain", "lipitor fu b12")


def test_delimited_file(spark, tmp_path):
    text = "ReportID,Age,Sex,Seriousness,ReportDay,Drugs,Events,TrueClusterID,extra\n007,54,female,SERIOUS,12.9,Lipitor 20mg; aspirin,throwing up,12.0,z\n007,x,,,inf,NA,;;,,\n,NaN,not Known,None,-3.7,a;a,b,q,\n"
    (tmp_path / "r.csv").write_text(text)
    rows = reports.read_reports(spark, f"file://{tmp_path}/r.csv").orderBy("idx").collect()
    assert [tuple(r) for r in rows] == [
        (0, "007", 54.0, "Female", "Serious", 12, ["aspirin", "atorvastatin"], ["nausea"], 12),
        (1, "007#2", None, None, None, 0, [], [], None),
        (2, "nan", None, "Not known", None, -3, ["a"], ["b"], None),
    ]


def test_order_over_many_files(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.csv").write_text("report_id\n" + "\n".join(f"{i}-{j}" for j in range(5)) + "\n")
    rows = reports.read_reports(spark, f"file://{tmp_path}").orderBy("idx").collect()
    assert [r.report_id for r in rows] == [f"{i}-{j}" for i in range(4) for j in range(5)] and [r.idx for r in rows] == list(range(20))


def test_repeated_ids_over_ranges(spark):
    step = 1 << 20
    rows = [(i * step // 2, "A" if i % 3 else "B") for i in range(12)] + [(7, None), (9, None)]
    got = {r.idx: r.report_id for r in reports.unique_ids(spark.createDataFrame(rows, "idx long, report_id string")).collect()}
    seen, want = {}, {}
    for idx, name in sorted(rows):
        seen[name] = seen.get(name, 0) + 1
        want[idx] = name if seen[name] == 1 else f"{name}#{seen[name]}" if name else f"{seen[name]}"
    assert got == want


def test_sample_and_template(spark, tmp_path):
    assert reports.sample_reports(spark, f"file://{tmp_path}/none.csv") is None
    (tmp_path / "t.csv").write_text(reports.TEMPLATE)
    rows = reports.sample_reports(spark, f"file://{tmp_path}/t.csv").orderBy("idx").collect()
    assert [r.drugs for r in rows] == [["aspirin", "atorvastatin"]] * 2 and rows[1].events == ["headache", "nausea"]


def test_columns_are_found_by_exact_name(spark):
    raw = spark.createDataFrame([(0, None, "5")], "idx long, Age string, report_day string")
    row = reports.parse(raw.withColumn("Sex", F.lit(" "))).first()
    assert (row.age, row.report_day, row.report_id, row.sex, row.drugs) == (None, 5, "", None, [])
    arrays = spark.createDataFrame([(0, [" Lipitor ", "", "zocor"])], "idx long, drugs array<string>")
    assert reports.parse(arrays).first().drugs == ["atorvastatin", "simvastatin"]


def test_round_trip_through_a_file(spark, tmp_path):
    raw = spark.createDataFrame([(0, "a,b", 1.5, None, "Serious", -4, ["x y"], ["e"], 3), (1, "q", None, "Male", None, 0, [], ["e", "f"], None)], reports.SCHEMA)
    reports.write_delimited(reports.file_shape(raw).coalesce(1), f"file://{tmp_path}/out")
    again = reports.parse(reports.read_delimited(spark, f"file://{tmp_path}/out"), normalize=False)
    assert sorted(map(str, again.collect())) == sorted(map(str, raw.collect()))


def test_cases(spark, tmp_path):
    drug = lambda *names, generic=(): {"medicinalproduct": names[0] if names else None, "openfda": {"generic_name": list(generic)}}
    case = lambda i, **p: {"safetyreportid": i, "serious": "1", "receiptdate": "20150111", "patient": {"drug": [drug(" Zocor ", generic=["simvastatin", ""])], "reaction": [{"reactionmeddrapt": "Rash"}, {}], **p}}
    results = [case("1", patientonsetage="6", patientonsetageunit="802", patientsex="2"), case("2", patientonsetage="130"), case("3", patientonsetage="5", patientonsetageunit="800"), case(""), case("5", drug=[]), {**case("6"), "receiptdate": "", "receivedate": "2014xx", "serious": None}, {"safetyreportid": "7"}]
    (tmp_path / "r.json").write_text(json.dumps({"meta": {}, "results": results}, indent=1))
    got = {r.ReportID: tuple(r)[1:] for r in casejson.flatten_cases(casejson.read_cases(spark, f"file://{tmp_path}/r.json")).collect()}
    assert got == {
        "1": (0.5, "Female", "Serious", 10, "Zocor;simvastatin", "Rash"),
        "2": (None, "", "Serious", 10, "Zocor;simvastatin", "Rash"),
        "3": (5.0, "", "Serious", 10, "Zocor;simvastatin", "Rash"),
        "6": (None, "", "Non-serious", 0, "Zocor;simvastatin", "Rash"),
    }


def test_case_service(spark):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps({"results": [{"safetyreportid": self.path.rpartition("=")[2]}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    casejson.register_case_service(spark)
    lines = spark.read.format("case_service").option("url", f"http://127.0.0.1:{server.server_port}/q").option("limit", "5000").load()
    assert [r.case.safetyreportid for r in casejson.parse_cases(lines).collect()] == ["1000"]
    server.shutdown()


def test_quoted_line_breaks_and_previews(spark, tmp_path):
    path = f"{tmp_path}/r.csv"
    with open(path, "w") as f:
        f.write('ReportID,Drugs\n1,"a;\nb"\n2,c\n3,d\n4,e\n')
    got = reports.read_delimited(spark, path, line_breaks=True)
    assert [(r.idx, r.ReportID, r.Drugs) for r in got.orderBy("idx").collect()] == [(0, "1", "a;\nb"), (1, "2", "c"), (2, "3", "d"), (3, "4", "e")]
    assert [r.ReportID for r in reports.preview(got).collect()] == ["1", "2", "3"]


def test_fetched_sample_is_flattened_and_saved(spark, tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from caseloom.sources import casejson

    case = {"safetyreportid": "9", "serious": "1", "patient": {"patientsex": "1", "drug": [{"medicinalproduct": "Lipitor"}], "reaction": [{"reactionmeddrapt": "Nausea"}]}}

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"results": [case, {"safetyreportid": "10"}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = casejson.fetch_sample(spark, f"http://127.0.0.1:{server.server_port}/q", f"{tmp_path}/sample").collect()
    finally:
        server.shutdown()
    assert [(r.ReportID, r.Sex, r.Drugs, r.Events) for r in got] == [("9", "Male", "Lipitor", "Nausea")]


def test_group_list_over_several_ranges(spark):
    from caseloom.operators import review

    ids = [5, 9, 1 << 20, (1 << 21) + 3, (1 << 40) + 1]
    rows = [(f"{c}-{i}", c, True) for c in ids for i in range(2)] + [("x", 7, False)]
    got = review.group_list(spark.createDataFrame(rows, "report_id string, cluster_id long, is_candidate_duplicate boolean")).orderBy("position").collect()
    assert [(r.cluster_id, r.position, r.previous, r.next) for r in got] == [(c, i + 1, ids[i - 1], ids[(i + 1) % 5]) for i, c in enumerate(ids)]
