import base64
import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from threadlens.functions.text import strip_html
from threadlens.operators.usage import describe_counts
from threadlens.session import scratch
from threadlens.sources import changes, providers as pr, store


def enc(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def raw(spark, *payloads):
    return spark.createDataFrame(
        [("u", json.dumps(p), i) for i, p in enumerate(payloads)],
        "user_id string, payload string, arrival_seq bigint")


def test_graph_full_and_bare(spark):
    got = pr.normalise_graph(raw(spark, {
        "id": "m1", "conversationId": "c1", "subject": "S", "from": {"emailAddress": {"address": "a@x"}},
        "toRecipients": [{"emailAddress": {"address": "b@x"}}, {"emailAddress": {}}, {}],
        "receivedDateTime": "2024-01-01T00:00:00Z", "hasAttachments": True,
        "body": {"content": "<p>b</p>"}, "bodyPreview": "p", "webLink": "w", "parentFolderId": "f"},
        {"id": "m2", "body": {"content": ""}, "bodyPreview": "preview"}, {"subject": "no id"}))
    assert [tuple(r) for r in got.orderBy("message_id").collect()] == [
        ("u", "m1", "c1", "S", "a@x", ["b@x"], "2024-01-01T00:00:00Z", True, "<p>b</p>", "w", "f", 0),
        ("u", "m2", "m2", "", "", [], "", False, "preview", "", "", 1)]


def part(mime, data=None, name="", aid=None, parts=None):
    return {"mimeType": mime, "filename": name, "body": {"data": data, "attachmentId": aid, "size": 3},
            "parts": parts}


def mime(spark, tree, depth=4):
    df = spark.createDataFrame([("u", "m", json.dumps(tree))], "user_id string, message_id string, payload string")
    return pr.mime_parts(df, depth)


def test_mime_order_body_and_attachments(spark):
    tree = part("multipart/mixed", parts=[
        part("multipart/alternative", parts=[part("text/plain", enc("plain")), part("text/html", enc("first"))]),
        part("text/html", enc("second")), part("image/png", name="i.png", aid="a1"),
        part("text/html", enc("file"), name="page.html")])
    parts = mime(spark, tree)
    assert [r["mimeType"] for r in parts.orderBy("visit").collect()] == [
        "multipart/mixed", "text/html", "image/png", "text/html", "multipart/alternative", "text/html", "text/plain"]
    assert rows(pr.mime_body(parts), "body") == [("second",)]
    assert rows(pr.mime_attachments(parts), "attachment_id", "name", "content_type", "size") == [
        ("a1", "i.png", "image/png", 3)]


def test_mime_deeper_than_one_stretch(spark):
    tree = part("text/plain", enc("deep"))
    for i in range(9):
        tree = part(f"multipart/{i}", parts=[part("image/x"), tree])
    parts = mime(spark, tree, depth=4)
    assert parts.count() == 19 and rows(pr.mime_body(parts), "body") == [("deep",)]
    # Any depth, a stretch at a time.
    parts = mime(spark, tree, depth=2)
    assert parts.count() == 19 and rows(pr.mime_body(parts), "body") == [("deep",)]


def test_a_mistyped_field_costs_that_field_alone(spark):
    def deep(levels, odd):
        tree = {**part("text/html", enc("kept")), **odd}
        for _ in range(levels):
            tree = part("multipart/mixed", parts=[part("text/plain", enc("other")), tree])
        return tree

    odd = {"body": {"data": enc("kept"), "size": "big"}, "headers": 3}
    cases = [deep(0, odd), deep(1, odd), deep(11, odd), deep(1, {"body": "text"}), deep(1, {"parts": {"a": 1}}),
             deep(2, {}), [1], None, part("multipart/mixed", parts=["no part", None, part("text/plain", enc("p"))])]
    df = spark.createDataFrame([("u", str(i), None if c is None else json.dumps(c)) for i, c in enumerate(cases)],
                               "user_id string, message_id string, payload string")
    for depth in (1, 4, 8):
        parts = pr.mime_parts(df, depth)
        assert rows(pr.mime_body(parts), "message_id", "body") == [
            ("0", "kept"), ("1", "kept"), ("2", "kept"), ("3", "other"), ("4", "kept"), ("5", "kept"), ("8", "p")]
        assert rows(pr.quarantine_parts(df, parts), "message_id", "error") == [
            ("0", "unreadable: body.size, headers"), ("1", "unreadable: body.size, headers"),
            ("2", "unreadable: body.size, headers"), ("3", "unreadable: body"), ("4", "unreadable: parts"),
            ("6", "malformed payload"), ("7", "no payload"), ("8", "unreadable: part")]
    gmail = spark.createDataFrame(
        [("u", json.dumps({"id": "m", "labelIds": "INBOX", "payload": cases[1]}), 0)],
        "user_id string, payload string, arrival_seq bigint")
    got = pr.normalise_gmail(gmail, spark.createDataFrame([], "user_id string, account string")).first()
    assert (got.message_id, got.body, got.container_id) == ("m", "kept", "")


def test_payloads_are_parsed_and_bodies_decoded_once(spark):
    df = raw(spark, part("multipart/mixed", parts=[part("text/plain", enc("p")), part("text/html", "")]))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString().lower()
    trees = df.select(pr.tree(F.col("payload")).alias("part")).filter("part IS NOT NULL")
    assert plan(df.filter(pr.tree(F.col("payload")).isNull())).count("parsejson") == 1
    assert plan(trees).count("parsejson") == 2  # the filter and the value
    bodies = pr.mime_body(mime(spark, part("multipart/mixed", parts=[part("text/plain", enc("p")), part("text/html", "")])))
    assert plan(bodies).count("tobinary") + plan(bodies).count("unbase64") == 1 and plan(bodies).count("min_by(") == 1
    assert rows(bodies, "body") == [("p",)]
    assert rows(pr.mime_body(mime(spark, part("text/html", ""))), "body") == []


def test_odd_bytes_become_replacement_characters(spark):
    latin = base64.urlsafe_b64encode("caf\u00e9".encode("latin-1")).decode()
    assert rows(pr.mime_body(mime(spark, part("text/plain", latin))), "body") == [("caf\ufffd",)]


def test_unreadable_payloads_are_put_aside(spark):
    good = json.dumps({"id": "m1", "subject": "S"})
    df = spark.createDataFrame([("u", good, 0), ("u", good[:-4], 1), ("u", None, 2), ("v", "[1, 2", 3), ("v", "{}", 4)],
                               "user_id string, payload string, arrival_seq bigint")
    assert rows(pr.normalise_graph(df), "message_id") == [("m1",)]
    assert rows(pr.quarantine(df, pr.GRAPH_MESSAGE, "user_id", "arrival_seq"), "user_id", "arrival_seq", "error") == [
        ("u", 1, "malformed payload"), ("u", 2, "no payload"), ("v", 3, "malformed payload")]
    pages = spark.createDataFrame(
        [("u", "a", json.dumps({"value": [{"id": "1", "conversationId": "c"}]}), 1), ("v", "b", '{"value": [', 2)],
        "user_id string, source_id string, payload string, seq bigint")
    assert rows(changes.delta_to_changes(pages), "user_id", "thread_id") == [("u", "c")]
    assert rows(pr.quarantine(pages, changes.DELTA_PAGE, "source_id"), "source_id") == [("b",)]


def test_gmail_message(spark):
    head = lambda **h: [{"name": k, "value": v} for k, v in h.items()]
    full = {"id": "m1", "threadId": "t1", "labelIds": ["INBOX", "TRASH"], "internalDate": "1700000000123",
            "payload": {**part("text/plain", enc("hi")),
                        "headers": head(SUBJECT="Sub", From="Ann <a@x>", to='"B, b" <b@x>, c@x')}}
    bare = {"id": "m2", "internalDate": "junk", "payload": {"headers": head(From="not an address")}}
    acc = spark.createDataFrame([("u", "me@x")], "user_id string, account string")
    got = pr.normalise_gmail(raw(spark, full, bare), acc)
    assert [tuple(r) for r in got.orderBy("message_id").collect()] == [
        ("u", "m1", "t1", "Sub", "a@x", ["b@x", "c@x"], "2023-11-14T22:13:20.123000+00:00", False, "hi",
         "https://mail.google.com/mail/?authuser=me@x#all/m1", "TRASH", 0),
        ("u", "m2", "m2", "", "", [], "", False, "", "https://mail.google.com/mail/?authuser=me@x#all/m2", "", 1)]
    none = pr.normalise_gmail(raw(spark, bare), acc.filter("false"))
    assert none.first()["web_link"] == "https://mail.google.com/mail/u/0/#all/m2"


def test_decode(spark):
    df = spark.createDataFrame(
        [("u", "m", str(i), v) for i, v in enumerate([enc("ab?>"), base64.b64encode(b"ab?>").decode(), "", None, "%%%"])],
        "user_id string, message_id string, attachment_id string, encoded string")
    assert rows(pr.decode_content(df), "attachment_id", F.decode("content", "UTF-8")) == [("0", "ab?>"), ("1", "ab?>")]


def test_attachment_payloads(spark):
    df = spark.createDataFrame([("u", "m", json.dumps({"value": [
        {"id": "1", "name": None, "contentType": "Application/PDF"}, {"name": "no id"}, {"id": "2", "size": 5}]}))],
        "user_id string, message_id string, payload string")
    assert rows(pr.normalise_attachments(df)) == [("u", "m", "1", "", "application/pdf", 0), ("u", "m", "2", "", "", 5)]


def test_change_feeds(spark):
    page = {"value": [{"id": "1", "conversationId": "c"}, {"id": "2", "@removed": {"reason": "x"}},
                      {"conversationId": "no id"}, {"id": "3"}]}
    df = spark.createDataFrame([("u", "f", json.dumps(page), 1)],
                               "user_id string, source_id string, payload string, seq bigint")
    assert rows(changes.delta_to_changes(df), "thread_id", "removed_message_id") == [("c", None), (None, "2")]
    m = lambda i, t=None: {"message": {"id": i, "threadId": t}}
    page = {"history": [{"messagesAdded": [m("1", "a"), m("2", "a")], "labelsRemoved": [m("3", "b")]},
                        {"messagesDeleted": [m("9", "c")], "labelsAdded": [m("1", "a"), {}]}]}
    df = spark.createDataFrame([("u", json.dumps(page), 4)], "user_id string, payload string, seq bigint")
    assert rows(changes.history_to_changes(df), "thread_id", "removed_message_id") == [
        ("a", None), ("b", None), (None, "9")]


def test_folder_tree_skips_subtrees(spark):
    f = spark.createDataFrame(
        [("u", "a", None, "A"), ("u", "b", "a", "B"), ("u", "junk", None, "J"), ("u", "j1", "junk", "J1"),
         ("v", "junk", None, "J"), ("u", "c", "b", "C")],
        "user_id string, folder_id string, parent_id string, name string")
    ex = spark.createDataFrame([("u", "junk")], "user_id string, folder_id string")
    assert rows(changes.folder_tree(f, ex), "user_id", "folder_id", "depth") == [
        ("u", "a", 0), ("u", "b", 1), ("u", "c", 2), ("v", "junk", 0)]


def test_strip_html_whitespace(spark):
    text = "<p>a  b</p>\n\x1c c <br\n/>d<script>x</script>"
    assert spark.range(1).select(strip_html(F.lit(text))).first()[0] == "a b c d x"


# Store -----------------------------------------------------------------------------

def tables(spark, n=7, tagged=4):
    threads = spark.range(n).select(
        F.lit("u").alias("user_id"), F.concat(F.lit("t"), "id").alias("thread_id"),
        F.when(F.col("id") < tagged, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("ai_tags"))
    return {"threads": threads, "users": spark.createDataFrame([("u",)], "user_id string")}


def test_snapshots(spark, monkeypatch):
    root = scratch(spark, "snap")
    assert store.versions(spark, root).count() == 0
    names = [store.snapshot(spark, tables(spark), root, keep=2) for _ in range(3)]
    assert [r["version"] for r in store.versions(spark, root).collect()] == names[:0:-1]
    assert store.verify(spark, root, names[2]) == {"threads": 7, "tagged": 4, "users": 1}
    assert all(r["bytes"] > 0 for r in store.listing(spark, root).collect())
    live = tables(spark, n=3)
    aside, back = store.restore(spark, root, names[1], live, keep=9)
    assert store.verify(spark, root, back)["threads"] == 7 and store.verify(spark, root, aside)["threads"] == 3
    before = store.versions(spark, root).count()
    monkeypatch.setattr(store, "verify", lambda *a: {"threads": 1, "tagged": 0, "users": 0})
    with pytest.raises(store.SnapshotMismatch):
        store.snapshot(spark, tables(spark), root)
    assert store.versions(spark, root).count() == before


def test_export_and_import(spark):
    path = scratch(spark, "exp")
    store.export_threads(tables(spark), path)
    store.check_export(spark, path)
    back = store.read_export(spark, path, "me")
    assert back.count() == 7 and back.filter("user_id = 'me' and body_scan_status = 'ok'").count() == 7
    bad = scratch(spark, "bad")
    spark.createDataFrame([('{"format":1,"thread_id":"a","subject":null}',), ("[1]",), ("{broken",),
                           ('{"format":1,"subject":"no id"}',), ('{"format":2,"thread_id":"b"}',)],
                          "value string").coalesce(1).write.text(f"{bad}/threads")
    assert rows(store.read_export(spark, bad, "me"), "thread_id", "subject", "n_messages") == [("a", "", 0)]
    none = scratch(spark, "none")
    spark.createDataFrame([('{"format":2}',)], "value string").write.text(f"{none}/threads")
    for refused in (store.check_export, lambda s, path: store.read_export(s, path, "me")):
        with pytest.raises(ValueError):
            refused(spark, none)


def test_describe_counts_of_empty_tables(spark):
    t = tables(spark)
    assert describe_counts(t["threads"].filter("false"), t["users"]).first().asDict() == {
        "threads": 0, "tagged": 0, "users": 1}
