import random

from pyspark.sql import functions as F

from helpers import rows
from threadlens.operators import attachments as att, threads as th
from threadlens.schemas import MESSAGES


def message(i, thread="t", date="2020-01-01T00:00:00Z", seq=0, **over):
    m = dict(user_id="u", message_id=i, thread_id=thread, subject=f"s-{i}", from_addr="a@x",
             to_addrs=["b@x"], date=date, has_attachments=False, body="", web_link=f"l-{i}",
             container_id="inbox", arrival_seq=seq)
    m.update(over)
    return tuple(m[c.split()[0]] for c in MESSAGES.replace("\n", " ").split(","))


def frame(spark, *messages):
    return spark.createDataFrame(list(messages), MESSAGES)


def test_grouping_order_and_first_last(spark):
    m = frame(spark, message("late", date="2020-02-01", seq=0), message("early", date="2020-01-01", seq=1),
              message("other", thread="t2", date="", seq=2))
    got = {r["thread_id"]: r for r in th.build_threads(m).collect()}
    assert got["t"]["n_messages"] == 2 and got["t2"]["n_messages"] == 1
    assert got["t"]["subject"] == "s-early" and got["t"]["date_first"] == "2020-01-01"
    assert got["t"]["date_last"] == "2020-02-01" and got["t2"]["date_first"] == ""


def test_repeated_id_keeps_the_first_arrival(spark):
    m = frame(spark, message("a", seq=5, subject="second"), message("a", seq=1, subject="first"))
    assert rows(th.build_threads(m), "subject", "n_messages") == [("first", 1)]


def test_equal_dates_follow_arrival(spark):
    m = frame(spark, message("z", seq=1), message("a", seq=2))
    assert rows(th.first_last(m), "first_id", "last_id") == [("z", "a")]


def test_any_attachment_and_undated_first(spark):
    m = frame(spark, message("a", date=None, seq=1), message("b", has_attachments=True, seq=2),
              message("c", has_attachments=None, seq=3))
    assert rows(th.build_threads(m), "has_attachments", "date_first", "n_messages", "day_min") == [
        (True, "", 3, "")]


def test_participants_sorted_distinct_without_blanks(spark):
    m = frame(spark, message("a", from_addr="x@y", to_addrs=["b@y", ""]),
              message("b", from_addr="b@y", to_addrs=["x@y"]),
              message("c", thread="none", from_addr="", to_addrs=None))
    assert rows(th.participants(m), "thread_id", "address") == [("t", "b@y"), ("t", "x@y")]


def test_excluded_containers(spark):
    m = frame(spark, message("a"), message("b", container_id="junk"), message("c", container_id=None))
    assert rows(th.drop_containers(m, ["junk"]), "message_id") == [("a",), ("c",)]


def brute_body(messages, limit):
    parts, cut, chars = [], False, 0
    for m in sorted(messages, key=lambda m: (m[6] or "", m[11], m[1])):
        text = " ".join(m[8].split())
        chars += len(text)
        cut |= len(text) > limit
        parts.append(text[:limit])
    whole = " ".join(p for p in parts if p)
    return whole[:limit], chars, "truncated" if cut or len(whole) > limit else "ok"


def test_body_of_a_very_long_thread(spark):
    rng = random.Random(7)
    many = [
        message(f"m{i}", date=f"2020-01-{rng.randint(1, 28):02d}", seq=i,
                body=" ".join(rng.choice(["", "w", "word", "ü" * rng.randint(1, 40)]) for _ in range(6)))
        for i in range(3000)
    ]
    small = [message("x", thread="small", body=" <b>hello</b>  world ", seq=1)]
    exact = [message("e1", thread="exact", body="a" * 60, seq=1), message("e2", thread="exact", body="b" * 39, seq=2)]
    got = {r["thread_id"]: r for r in th.thread_content(frame(spark, *many, *small, *exact), 100).collect()}
    assert tuple(got["t"])[2:] == brute_body(many, 100)
    assert got["small"]["body_text"] == "hello world" and got["small"]["body_scan_status"] == "ok"
    assert tuple(got["exact"])[2:] == brute_body(exact, 100) and got["exact"]["body_scan_status"] == "ok"


def test_changed_threads(spark):
    t = "user_id string, thread_id string, date_last string"
    current = spark.createDataFrame([("u", k, "2020") for k in ("newer", "same", "older", "forced")], t)
    rebuilt = spark.createDataFrame(
        [("u", "new", "1999"), ("u", "newer", "2021"), ("u", "same", "2020"), ("u", "older", "2019"),
         ("u", "forced", "2019")], t)
    kept = th.changed_threads(current, rebuilt, rebuilt.filter("thread_id = 'forced'"))
    assert rows(kept, "thread_id") == [("forced",), ("new",), ("newer",)]


def test_scan_status_cases(spark):
    meta = spark.createDataFrame(
        [("u", "m", "1", "a.xlsx", "", 1), ("u", "m", "2", "a.pdf", "", 1), ("u", "m", "3", "A.DOCX", "", 1),
         ("u", "m", "4", "b.docx", "", 1), ("u", "m", "5", "c.pdf", "", None), ("u", "off", "6", "d.pdf", "", 1),
         ("other", "m", "7", "theirs.pdf", "", 99)],
        "user_id string, message_id string, attachment_id string, name string, content_type string, size bigint")
    texts = spark.createDataFrame(
        [("u", "m", "1", "x"), ("u", "m", "3", "hello world"), ("u", "m", "4", "y" * 5500), ("u", "m", "5", ""),
         ("other", "m", "2", "not mine")],
        "user_id string, message_id string, attachment_id string, text string")
    child = spark.createDataFrame([("u", "t", "m", True), ("u", "t", "off", False)],
                                  "user_id string, thread_id string, message_id string, has_attachments boolean")
    got = att.attach(child, meta, texts)
    assert rows(got, "attachment_id", "scan_status", "actual_char_count", F.length("text"), "size") == [
        ("1", "unsupported", 0, 0, 1), ("2", "failed", 0, 0, 1), ("3", "ok", 11, 11, 1),
        ("4", "truncated", 5500, 5000, 1), ("5", "failed", 0, 0, 0)]
    assert "text" not in att.storage_columns(got).columns
    assert rows(att.per_thread(got), "max_attachment_size", "attachments_incomplete") == [(1, True)]


def test_extract_text_survives_bad_files(spark):
    files = spark.createDataFrame(
        [(1, "a.docx", "", b"not a zip"), (2, "b.txt", "", b"text"), (3, "c.pdf", "", b"%PDF"),
         (4, "d.docx", "", None)], "k int, name string, content_type string, content binary")
    assert rows(att.extract_text(files), "k", "text") == [(1, None), (2, None), (3, None), (4, None)]
