"""Golden mails, one-rule probes, gap cases and robustness, each analysed once."""

import pytest
from pyspark.sql import functions as F

from mailsift.data import lists
from mailsift.data.catalogue import ALL_RULES
from mailsift.data.samples import GOLDEN, GOLDEN_EXPECTED, PROBES
from mailsift.operators.scoring import with_recommendations
from mailsift.plans.analysis import analyse, verdict

# (text, rules that fire in order, score)
GAPS = [
    ("See https://qqzzk.example:8443/x", ["nonstandard_port"], 6),
    ("See https://safe.example@qqzzk.example/x", ["at_sign_in_url"], 12),
    ("See https://qqzzk.example/?e=a@zzkqq.example", ["at_sign_in_url"], 12),
    ("See https://qqzzk.example/%61%62%63", ["encoded_url_chars"], 6),
    ("See https://[2001:db8::1]", ["ip_address_url", "nonstandard_port"], 18),
    ("Kept in files_a.rar", ["archive_attachment"], 8),
    ('Sent: "files_a.zip"', ["risky_tld"], 10),
    ("Kept in notes.svg", ["risky_attachment"], 8),
    ("Kept in plan.pdf.exe", ["double_extension"], 18),
    ("<div><p>" + "&#65;" * 12 + "</p></div>", ["entity_obfuscation"], 6),
    ('<div><p><a href="javascript:go()">x</a></p></div>', ["javascript_href"], 12),
    ('<div><p><a href="data:text/plain,x">x</a></p></div>', ["data_uri_link"], 10),
    ('<div><p style="opacity:0.5">x</p></div>', ["hidden_content"], 10),
    ('From: "Billing Desk" <desk@gmail.com>\nSubject: note\n\nhi there', ["free_mail_sender"], 10),
    ("From: <a@qqzzk.example>\nSubject: note\nX-Spam-Flag: YES\n\nbody", ["spam_header"], 10),
    ("From: <a@qqzzk.example>\nReceived: from x\nSubject: note\n\nbody", ["missing_headers"], 4),
    ("A penalty applies.", ["threat_of_financial_loss"], 9),
    ("Dear Customer, please confirm your password", ["password_request", "generic_greeting"], 23),
    ("", [], 0), ("   \n\t  ", [], 0), (None, [], 0),
    ("ñfine", ["threat_of_financial_loss"], 9),
    ("<><><> \\\\ %%% ### @@@ [.][]", [], 0),
    ("a" * 399_999, [], 0),
]
DOTTED = "a." * 150_000
LONG = "tide " * 70_000
FIELDS = "From: <a@qqzzk.example>\n" + "".join(f"Received: from relay{i}\n" for i in range(200)) + "X-Spam-Flag: YES\nSubject: s\n\nlate"
REMOTE = "<html><body>" + "".join(f'<img src="https://h{i}.example/p.png">' for i in range(12)) + "</body></html>"
HTML = ('<html><body><p style="visibility:hidden">seaweed and sand</p>'
        '<form action="https://boats-qqzzk.example/in"><input name="pin" type="password"></form>'
        '<p>Boats: <a href="https://boats-qqzzk.example/hire">www.harbour-office.com/boats</a></p>'
        '<img width="1" height="1" src="https://count-qqzzk.example/c.png"></body></html>')


@pytest.fixture(scope="module")
def results(spark):
    texts = ([(f"golden {g}", t) for g, t in GOLDEN.items()] + [(f"probe {i}", t) for i, (t, _) in enumerate(PROBES)]
             + [(f"gap {i}", t) for i, (t, _, _) in enumerate(GAPS)] + [("dotted", DOTTED), ("html", HTML), ("remote", REMOTE), ("fields", FIELDS),
                ("far link", LONG + "https://[2001:db8::1]")])
    df = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(texts)], "msg_id long, name string, raw string")
    done = with_recommendations(analyse(df.repartition(8)))
    rows = verdict(done, "name", "findings", "truncated", "characters", "is_empty", "recommendations", "remote_hosts").collect()
    return {r["name"]: r for r in rows}


def fired(row):
    return [f["rule_id"] for f in row["findings"]]


def test_goldens_have_their_exact_points(results):
    for name, (band, low, high, raw) in GOLDEN_EXPECTED.items():
        r = results[f"golden {name}"]
        assert (r["raw_score"], r["score"], r["band"]) == (raw, min(raw, 100), band), name


def test_probes_fire(results):
    for i, (_, expected) in enumerate(PROBES):
        assert set(expected) <= set(fired(results[f"probe {i}"])), i


def test_gap_cases(results):
    for i, (text, rules, score) in enumerate(GAPS):
        r = results[f"gap {i}"]
        assert (fired(r), r["score"]) == (rules, score), (i, text)


def test_limits(results):
    huge = results[f"gap {len(GAPS) - 1}"]
    assert huge["truncated"] and huge["characters"] == 399_999
    assert all(results[f"gap {i}"]["is_empty"] for i in (18, 19, 20))
    assert results["dotted"]["score"] >= 0


def test_nothing_is_cut_off(spark, results):
    assert "ip_address_url" in fired(results["far link"]) and results["far link"]["truncated"]
    assert "spam_header" in fired(results["fields"]) and results["fields"]["headers_found"]
    assert len(results["remote"]["remote_hosts"]) == 12
    cut = analyse(spark.createDataFrame([(1, LONG + "https://[2001:db8::1]")], "msg_id long, raw string"),
                  limit=lists.MAX_CHARACTERS)
    assert cut.select(F.size("urls")).first()[0] == 0


def test_html_source(results):
    assert {"misleading_link_text", "embedded_login_form", "hidden_content", "tracking_pixel",
            "remote_resources"} <= set(fired(results["html"]))


def test_invariants(results):
    points = {r.rule_id: r.points for r in ALL_RULES}
    for r in results.values():
        ids = fired(r)
        assert len(ids) == len(set(ids))
        assert r["raw_score"] == sum(points[i] for i in ids) and r["score"] == min(100, r["raw_score"])
        texts = [x["text"] for x in r["recommendations"]]
        assert len(texts) == len(set(texts)) <= 8 and texts[0].startswith("Do not click")


def test_registry_is_complete():
    assert len(ALL_RULES) == len({r.rule_id for r in ALL_RULES}) == 59
    assert sum(len(r.patterns) for r in ALL_RULES) == 78
