"""Accounts, HTTP requests, event streams, agent tools and PDF pages."""

import json
import threading
import urllib.error
import urllib.request
import zlib

import pytest

from tessera.plans.errors import RequestShape, UnknownField
from tessera.plans.interfaces import HashedEmbedder
from tessera.service import accounts as A
from tessera.service.http import KEEPALIVE, Service, frames
from tessera.service.tools import CAVEAT, Tools
from tessera.sources.pdf import BadPdf, page_texts
from tessera.sources.tabular import pdf_pages
from tessera.streaming.hub import Hub


def test_passwords():
    own = A.hash_password("correct horse", iterations=1000)
    assert A.verify_password("correct horse", own) and not A.verify_password("wrong", own) and own != A.hash_password("correct horse", iterations=1000)
    for bad in ("", "x", own.replace("pbkdf2", "md5"), own.replace("$1000$", "$0$"), own.replace("$1000$", "$99999999$"), own.replace("sha256", "sha1"), own.rsplit("$", 1)[0] + "$", own + "$x"):
        assert not A.verify_password("correct horse", bad)


def test_accounts(spark):
    users = spark.createDataFrame([("1", "Ann", "h", "admin", True), ("2", "ben", "h", "member", True), ("3", "cy", "h", "admin", False)], "user_id string, username string, password_hash string, role string, active boolean")
    for change in ({"role": "member"}, {"active": False}):
        with pytest.raises(RequestShape):
            A.update_user(users, "1", **change)
    with pytest.raises(RequestShape):
        A.update_user(users, "2", username="ANN")
    with pytest.raises(UnknownField):
        A.update_user(users, "9", active=True)
    two = A.update_user(users, "2", role="admin")
    assert A.update_user(two, "1", active=False).where("active and role = 'admin'").count() == 1
    token, sessions = A.new_session(spark.createDataFrame([], "token_hash string, user_id string"), "2")
    assert [r.username for r in A.session_user(sessions, users, token).collect()] == ["ben"] and token not in str(sessions.collect())
    assert A.session_user(sessions, A.update_user(users, "2", active=False), token).count() == A.session_user(sessions, users, "other").count() == 0
    assert A.without_session(sessions, token).count() == 0


def test_requests_over_http(spark):
    df = spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "b"), (3, 30.0, "c")], "qty int, amount double, name string")

    def source(ref):
        if ref == "broken":
            raise RuntimeError("a secret path")
        return df

    server = Service(source).server()
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def post(path, body):
        data = body if isinstance(body, bytes) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as error:
            return error.code, json.loads(error.read())

    try:
        assert post("/execute", {"data_source_ref": "x", "aggregation": "avg", "field": "amount", "filters": [{"field": "qty", "op": "gt", "value": 1}]}) == (200, {"amount": 25.0, "row_count": 2})
        assert post("/introspect", {"data_source_ref": "x", "targets": ["AMOUNT"]})[1]["targets"] == [{"target": "AMOUNT", "column": "amount", "matched": True}]
        assert sorted(r["count"] for r in post("/analyze", {"data_source_ref": "x", "kind": "contingency", "columns": [{"name": "name"}]})[1]["rows"]) == [1, 1, 1]
        assert post("/execute", {"data_source_ref": "x", "aggregation": "median", "field": "amount"})[0] == 400
        assert post("/execute", {"aggregation": "avg"}) == (400, {"error": "data_source_ref is required", "kind": "RequestShape"})
        assert post("/execute", {"data_source_ref": "broken", "aggregation": "avg", "field": "x"}) == (500, {"error": "internal error"})
        assert post("/execute", b"{")[0] == post("/execute", b"[]")[0] == 400 and post("/none", {"data_source_ref": "x"})[0] == 404
    finally:
        server.shutdown()


def test_event_streams():
    hub = Hub()
    hub.publish("g", "candidate", {"n": 1})
    stream = frames(hub, "g", keepalive=0.05)
    assert next(stream) == b'data: {"type": "candidate", "payload": {"n": 1}}\n\n' and next(stream) == KEEPALIVE
    hub.publish("g", "candidate", {"n": 2})
    assert json.loads(next(stream)[6:])["payload"] == {"n": 2}
    stream.close()
    assert not hub.subscribers["g"]


def test_agent_tools(spark):
    embed = HashedEmbedder(64)
    texts = {"h1": "late orders of large customers", "h2": "rain over the mountains", "h3": "late orders"}
    vectors = spark.createDataFrame([(k, "g1", v) for k, v in zip(texts, embed(list(texts.values())), strict=True)], "node_id string, goal_id string, embedding array<double>")
    tables = {
        "vectors": vectors, "goals": spark.createDataFrame([("g1", "d1")], "goal_id string, dataset_id string"),
        "heuristics": spark.createDataFrame([(k, t, k == "h3") for k, t in texts.items()], "node_id string, definition string, stale boolean"),
        "evidence": spark.createDataFrame([("h1", "i1"), ("h2", "s2")], "heuristic_id string, node_id string"),
        "edges": spark.createDataFrame([("s1", "i1", "o1", 1.0, 0.9, "causal_inferred", False, 1), ("s2", "i2", "o2", 1.0, 0.5, None, False, 1)], "state_id string, intervention_id string, outcome_id string, effect_size double, confidence double, epistemic_source string, superseded boolean, graph_version int"),
    }
    tools = Tools(tables, embed, lambda goal, path: f"of:{goal}", lambda goal, finding: "accepted" if finding == "i1" else "over_budget", floor=0.9)
    ask = lambda method, **params: tools.answer({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    call = lambda name, **given: ask("tools/call", name=name, arguments=given)["result"]
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["get_optimized_heuristics", "trace_causal_chain", "submit_analyst_goal", "verify_finding"]
    found = json.loads(call("get_optimized_heuristics", operational_state=" late orders ")["content"][0]["text"])
    assert found == {"heuristics": [{"id": "h1", "definition": texts["h1"], "epistemic_source": "causal_inferred", "refutation_confidence": 0.9, "caveat": CAVEAT}]}
    assert json.loads(call("trace_causal_chain", meta_heuristic_id="h2")["content"][0]["text"]) == {"triplets": [{"state_id": "s2", "intervention_id": "i2", "outcome_id": "o2", "epistemic_source": "observational"}]}
    assert json.loads(call("submit_analyst_goal", goal="more", import_path="a.csv")["content"][0]["text"]) == {"optimization_function_id": "of:more"}
    assert [json.loads(call("verify_finding", goal_id="g1", finding_id=i)["content"][0]["text"])["dispatched"] for i in ("i1", "i2")] == [True, False]
    assert call("get_optimized_heuristics", operational_state=" ")["isError"] and call("nothing")["isError"]
    assert ask("nothing")["error"]["code"] == -32601 and tools.answer({"method": "notifications/initialized"}) is None


def test_traces_stay_tables(spark):
    """The query's rows do not pass through the driver, and are those of the tool's message; nulls in ids and repeated edges too."""
    from tessera.queries.rules import traced

    evidence = spark.createDataFrame([("h2", "s1"), ("h2", "s1"), ("h2", "i2"), ("h1", "o9")], "heuristic_id string, node_id string")
    rows = [("s1", "i1", "o1", "causal_inferred"), ("s1", "i1", "o1", "causal_inferred"), ("s2", "i2", "o2", None), (None, "i2", "o3", "observational"), ("s9", "i9", "o9", None)]
    edges = spark.createDataFrame(rows, "state_id string, intervention_id string, outcome_id string, epistemic_source string")
    spark.sparkContext.setJobGroup("trace", "trace")
    found = traced(evidence, edges)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("trace")
    tools = Tools({"evidence": evidence, "edges": edges}, None, None, None)
    told = tools.call("trace_causal_chain", {"meta_heuristic_id": "h2"})["triplets"]
    assert [(x["intervention_id"], x["outcome_id"], x["epistemic_source"], "caveat" in x) for x in told] == [("i1", "o1", "causal_inferred", True), ("i2", "o2", "observational", False), ("i2", "o3", "observational", False)]
    assert sorted(map(tuple, found.collect())) == sorted((x["intervention_id"], x["outcome_id"], x["epistemic_source"], "caveat" in x) for x in told)


def pdf(*pages: bytes, packed: bool = False) -> bytes:
    """A file of plain pages; packed: streams deflated, pages in an object stream."""
    n = len(pages)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + i) for i in range(n)) + b"] /Count %d >>" % n}
    objects |= {10 + i: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 5 0 R >> >> >>" % (100 + i) for i in range(n)} | {5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    shown = lambda b: (zlib.compress(b), b"/Filter /FlateDecode ") if packed else (b, b"")
    out = [b"%PDF-1.5"]
    if packed:
        body = b" ".join(objects.values())
        places, at = [], 0
        for k, v in objects.items():
            places.append(b"%d %d" % (k, at))
            at += len(v) + 1
        first = b" ".join(places) + b" "
        data, how = shown(first + body)
        out.append(b"50 0 obj << /Type /ObjStm " + how + b"/N %d /First %d >> stream\n" % (len(objects), len(first)) + data + b"\nendstream endobj")
    else:
        out += [b"%d 0 obj %s endobj" % x for x in objects.items()]
    for i, p in enumerate(pages):
        data, how = shown(p)
        out.append(b"%d 0 obj << " % (100 + i) + how + b"/Length %d >> stream\n" % len(data) + data + b"\nendstream endobj")
    return b"\n".join([*out, b"%%EOF"])


PAGES = [rb"BT /F1 12 Tf 72 700 Td (Total: \(net\) 7\0545) Tj 0 -14 Td [(Amo) -20 (unt) -300 (due)] TJ ET", b"BT (caf\xe9) Tj T* <48 69> Tj ET", b"0 0 m 10 10 l S"]
TEXTS = ["Total: (net) 7,5\nAmount due", "café\nHi", ""]


@pytest.mark.parametrize("packed", [False, True])
def test_pages_of_pdf_files(spark, tmp_path, packed):
    assert list(page_texts(pdf(*PAGES, packed=packed))) == TEXTS
    (tmp_path / "a.pdf").write_bytes(pdf(*PAGES, packed=packed))
    rows = pdf_pages(spark, str(tmp_path / "a.pdf")).orderBy("page_idx").collect()
    assert [(r.page_idx, r.text) for r in rows] == list(enumerate(TEXTS))


def test_bad_pages_fail_the_read():
    good = pdf(*PAGES)
    for bad in (b"", b"text", good.replace(b"102 0 obj", b"999 0 obj"), good.replace(b"/Type1", b"/Type0"), good.replace(b"/Type /Catalog", b"/Type /None"), pdf(*PAGES, packed=True).replace(b"stream\nx", b"stream\nq", 2), good + b"trailer << /Encrypt 9 0 R >>"):
        with pytest.raises(BadPdf):
            list(page_texts(bad))
