"""Scalar functions on hand-written rows."""

import ipaddress

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.functions import chat, network, text
from siftwork.operators.outbox import error_map
from siftwork.sources.requests import parsed
from siftwork.sources.schemas import USERS, chat_requests, conform


def run(spark, values, *columns, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] if len(columns) == 1 else tuple(r) for r in df.select(*[c(F.col("x")) for c in columns]).collect()]


def test_tokens(spark):
    values = ["12.ab.cd", "12", "12.", ".x", " 12 .x", "99999999999999999999.x", None, "a.b"]
    assert run(spark, values, text.token_id, text.token_secret) == [(12, "ab.cd"), (None, None), (None, None), (None, None), (12, "x"), (None, None), (None, None), (None, None)]


def test_masks(spark):
    values = ["ab@x.org", "a@x", "@x", "a@", "a@b@c", "none", "", None]
    assert run(spark, values, text.mask_one, text.mask_two) == [("a******@x.org", "ab******@x.org"), ("a******@x", "a*******@x"), *[("", "")] * 6]


def test_email_checks(spark):
    values = ["a@b.c", "a@b.c\n", "a b@c.d", "a@b", "@b.c", "a@", " a@b ", None]
    assert run(spark, values, text.is_email) == [True, False, False, False, False, False, False, False]
    assert run(spark, values, text.is_email_loosely) == [True, True, True, True, False, False, True, False]


def test_strip_takes_unicode_space(spark):
    assert run(spark, ["  x　", None, ""], text.stripped, text.stripped_or_empty) == [("x", "x"), (None, ""), ("", "")]


def test_session_ids(spark):
    whole = "0123456789ABCDEF0123456789abcdef"
    dashed = "01234567-89ab-cdef-0123-456789abcdef"
    assert run(spark, [whole, dashed, "{" + dashed + "}", whole[:-1], "x", None], text.session_id) == [dashed, dashed, dashed, None, None, None]


def test_retry_after(spark):
    assert run(spark, ["30", "0", "-4", "30s", "9000", "x", "", None], lambda c: text.retry_after_header(c, 600)) == [30, None, None, 30, 600, None, None, None]


def test_prompt_keeps_last_eight(spark):
    turns = [("user" if i % 2 == 0 else "ai", str(i)) for i in range(11)]
    df = spark.createDataFrame([("m", turns), ("m", turns[:3]), ("m", []), (None, None)], "message string, history array<struct<role:string,content:string>>")
    got = [r[0].split("\n") for r in df.select(chat.prompt(F.col("message"), F.col("history"))).collect()]
    assert [g[3:-3] for g in got[:2]] == [[f"{'AI' if i % 2 else '使用者'}：{i}" for i in range(3, 11)], ["使用者：0", "AI：1", "使用者：2"]]
    assert got[2][3:-3] == got[3][3:-3] == [""]


def test_chat_requests(spark):
    bodies = ['{"message": "x"}', '{"message": "x", "history": [{"role": "ai", "content": "y"}]}', '{"message": "x", "history": [{"role": "system", "content": "y"}]}', "{}", "no json", None]
    df = chat_requests(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert [r["ok"] for r in df.collect()] == [True, True, False, False, False, False]


def test_conform_names_missing_columns(spark):
    try:
        conform(spark.range(1), USERS)
    except ValueError as e:
        assert "email" in str(e)
    else:
        raise AssertionError("no error")


def test_gate(spark):
    rows = [("/docs", None, "10.1.2.3"), ("/docs", "1.1.1.1", "10.1.2.3"), ("/docs", None, "8.8.8.8"), ("/docs", None, "no"), ("/docs", None, None), ("/x", "1.1.1.1", None), ("/redoc", "", "::1")]
    df = spark.createDataFrame(rows, "p string, h string, ip string")
    got = [r[0] for r in df.select(network.passes_gate(F.col("p"), F.col("h"), network.is_private(F.col("ip")))).collect()]
    assert got == [True, False, False, False, False, True, True]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.ip_addresses().map(str), st.text(max_size=8)), min_size=20, max_size=40))
def test_private_addresses_match_the_library(spark, hosts):
    nets = [ipaddress.ip_network(n) for n in (*network.PRIVATE_V4, *network.PRIVATE_V6)]

    def known(h):
        try:
            return any(ipaddress.ip_address(h) in n for n in nets)
        except ValueError:
            return False

    hosts += ["::1%eth0", "::1%", "0:0:0:0:0:0:0:1", "::0.0.0.1", "::10.0.0.1", "1::1", "::01", "0::0:1", "FD00::1", "fd00:1:2:3:4:5:6:7", "fd00:1:2:3:4:5:6::", "fd00::1:2:3:4:5:6:7", "fc:0::", ":::1", "::1::", "fe80", "fd00:::", "fdff:1:2:3:4:5:1.2.3.4", "fd00:1:2:3:4:5:6:1.2.3.4", "fd00::1.2.3.256", "::10", "1::"]
    hosts = [h for h in hosts if h.isprintable()] + ["172.16.0.0", "172.32.0.0", "fe80::1", "febf::", "fec0::", "010.0.0.1"]
    assert run(spark, hosts, network.is_private) == [known(h) for h in hosts]


def test_request_records(spark):
    long = "p" * 8
    bodies = ['{"email": " a@b ", "username": "abc", "password": "' + long + '"}', '{"email": "ab", "username": "   abc   ", "password": "1234567"}', "[]", "no json", None, "{}"]
    got = [(r["email"], r["username"], r["faulty"]) for r in parsed(spark.createDataFrame([(b,) for b in bodies], "body string"), "register").collect()]
    all_of = ["email", "username", "password"]
    assert got == [("a@b", "abc", []), ("ab", "abc", ["email", "password"]), *[(None, None, all_of)] * 4]
    resend = parsed(spark.createDataFrame([("{}",), ('{"email": "  x"}',)], "body string"), "resend_verification").collect()
    assert [(r["email"], r["faulty"]) for r in resend] == [(None, []), ("  x", [])]


def test_error_map(spark):
    df = spark.createDataFrame([(True, False), (True, True), (None, False)], "a boolean, b boolean")
    got = [r[0] for r in df.select(error_map({"email": F.col("a"), "username": F.col("b")}, {"email": "taken", "username": "in use"})).collect()]
    assert got == [{"email": "taken"}, {"email": "taken", "username": "in use"}, {}]


def test_stored_email(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-01 00:00:00'), ('a', TIMESTAMP_NTZ '2024-01-01 00:00:01'), ('a', NULL), (NULL, NULL) AS t(e, x)")
    now = F.lit("2024-01-01 00:00:01").cast("timestamp_ntz")
    assert [r[0] for r in df.select(text.stored_email(F.col("e"), F.col("x"), now)).collect()] == ["", "a", "a", ""]
