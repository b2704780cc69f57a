import hashlib
import re

from cases import by_id, documents, empty_documents, odd_documents
from conftest import SF_SMALL
from keelson.llm import pii, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def plain_base(text) -> list:
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or \
                    kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or \
                    kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_query_equals_brute_force(spark):
    texts = documents(SF_SMALL)
    got = by_id(queries.op6_pii(spark, SF_SMALL))
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        base = plain_base(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), (i, base, got[i])
        assert got[i]["n_card"] == sum(x.startswith("card") for x in base)


TRICKY = ["a@b.c@d.e f@g.h_i@j.k", "x@y. x@y..z %+@a-.b.c", "1.2.3.4.5 256.1.1.1 0001.02.3.255 1.2.3 12.13.14.15.16.17.18.19",
          "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112222 4111111111111111a",
          "+1 (377) 555-0271 +12 ++4420 7946 0958. +1-2 +123456789012345678", "é+49 30 123456é 日1.2.3.4本", "1" * 40 + " 79927398713" * 2,
          "\u0001a@b.c\u0002 +1 377 555 0271\u0001"]


def test_tricky_texts(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = by_id(pii.find_pii(df))
    for i, text in enumerate(TRICKY):
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in got[i]["spans"] if s["kind"] in pii.KINDS] == plain_base(text)


def test_bootstrap_discovers_in_trusted_contexts_only(spark):
    rows = [f"please dial extension +1 (200) 555-{i:04d} now, of the +1 (300) 555-{i:04d}" for i in range(6)]
    rows += ["please dial extension (555) 010-4477 now", "of the 555 010 4488 men", "of the men of the hill of the lake of the sea"] * 3
    rows += ["part number here 555 010 4499"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {i: [s for s in r["spans"] if s["kind"].startswith("ctx_")] for i, r in by_id(pii.find_pii(df)).items()}
    assert {i for i, s in found.items() if s} == {6, 9, 12}                  # every copy, and no other row
    assert rows[6][found[6][0]["start"]:found[6][0]["end"]] == "(555) 010-4477" and found[6][0]["kind"] == "ctx_phone"


def test_spelled_out_addresses_are_discovered(spark):
    forms = ["jane.roe at example dot com", "jane.roe at example.com", "jane.roe (at) example dot com", "jane.roe at mail dot example.com",
             "jane.roe at example (dot) com", "jane.roe(at)example(dot)com", "jane.roe [at] example [dot] com", "jane.roe (at) example. com"]
    ends = ["", " today", ". He said so"]
    rows = [f"please write to user{i}@example.org now, or to them" for i in range(60)] + \
        [f"please write to {form}{end}" for form in forms for end in ends] + ["please write to me at home. He is out", "we met joe.roe at example dot com"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {i: [rows[i][s["start"]:s["end"]] for s in r["spans"] if s["kind"] == "ctx_email"] for i, r in by_id(pii.find_pii(df)).items()}
    assert found == {i: [] for i in range(len(rows))} | {60 + i: [forms[i // len(ends)]] for i in range(len(forms) * len(ends))}


def test_trusted_values_give_patterns_and_are_reported_everywhere(spark):
    rows = [f"please dial extension +1 (200) 555-{i:04d} now" for i in range(20)]
    rows += [f"please dial extension 555 010 447{i} now" for i in range(4)]               # trusted in the first hop
    rows += [f"you may ring me on 555 010 447{i}" for i in range(4)]                      # the same values elsewhere
    rows += ["you may ring me on 555 010 9999", "the part number 555 010 8888", "the part number 555 010 4471"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {i: [rows[i][s["start"]:s["end"]] for s in r["spans"] if s["kind"] == "ctx_phone"] for i, r in by_id(pii.find_pii(df)).items()}
    want = {i: [f"555 010 447{(i - 20) % 4}"] for i in range(20, 28)} | {28: ["555 010 9999"], 30: ["555 010 4471"]}
    assert {i: s for i, s in found.items() if s} == want


def test_copies_lend_no_support(spark):
    rows = ["please dial extension +1 (200) 555-0001 now"] * 50 + ["please dial extension (555) 010-4477 now"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert not [s for r in pii.find_pii(df).collect() for s in r["spans"] if s["kind"].startswith("ctx_")]


def test_odd_rows(spark):
    df = odd_documents(spark)
    out = pii.find_pii(df).collect()
    assert len(out) == df.count() and all(r["spans"] is not None for r in out)
    assert pii.find_pii(empty_documents(spark)).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.entities(df, "doc_id", "text", 100)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
