"""Messages made from the given tables.

``orders`` become mails (one template per order, chosen by its key, sent through
a host chosen by its customer); ``documents``, ``pages`` and ``conversations``
are taken as they are. Every row of every table is used, whole.

Sources of one's own only need ``msg_id`` and ``raw`` (see ``files.py``).
"""

from pyspark.sql import functions as F

from mailsift.data.samples import GOLDEN, GOLDEN_EXPECTED, PROBES
from mailsift.sources.files import spread

HOSTS = ["qqzzk.example", "203.0.113.9", "bit.ly", "a.b.qqzzk.xyz", "paypa1.example", "login.micros0ft-help.example",
         "www.netflix-billing.example", "xn--pypal-4ve.example", "docs.qqzzk.co.uk", "qqzzk.example:8443", "barclays.co.uk"]

# Where a golden mail stands among the templates; its copies are a campaign of equal texts.
GOLDEN_IDS = list(GOLDEN)

_NOTES = [
    'From: "Desk" <desk@qqzzk.example>\nSubject: note #k#\n\nSee https://#h#/p/#k# for the notes.',
    "Dear Customer,\nplease confirm your password within the next 6 hours: http://#h#/login?id=#k#",
    "Kept in plan_#k#.pdf.exe",
    '<div><p style="display:none">x</p><a href="https://#h#/a">www.qqzzk.com</a></div>',
    "Nothing to see in note #k#.",
    "See https://safe.example@#h#/x#k# and hxxps://#h#/%61%62%63 or http://#h#/?u=zzkqq.com http://#h#/?u=zzkqq.com.",
    "See https://[2001:db8::1] and mail desk@qqzzk.com, (see qqzzk.com) qqzzk.com ok.In case",
    'Kept in files_#k#.rar\nSent: "files_a.zip" and again files_a.zip\n(notes.svg) [image_1.html] <doc.xls>',
    "<div><p>" + "&#65;" * 12 + '</p></div><a href=javascript:go()>x</a> <a href="data:text/plain,x">x #k#</a>%3c%3E%3c',
    '<html><body><a class="b" href=\'http://#h#/login\'>https://login.microsoft.com/auth &amp; more</a>'
    '<img src="https://#h#/pixel.gif" width="1" height="1"><img height=0 width=0 src="http://two.example/a">'
    '<form action="https://#h#/post"><input type="password" name="password"></form>'
    '<a href="https://bit.ly/#k#">read on</a><span style="opacity:0.5">#k#</span></body></html>',
    'From: "Billing Desk" <desk@gmail.com>\nSubject: note #k#\n\nhi there',
    "From: <a@qqzzk.example>\r\nSubject: note\r\nX-Spam-Flag: YES\r\nX-Spam-Status: No, score=#k#\r\n\r\nbody\r\nline #k#",
    "\n \nFrom: <a@qqzzk.example>\nReceived: from x\nReceived: by y\n\twith id #k#\nSubject: note\n\nbody\nReceived: no",
    "From: 'PayPal Service' <service@#h#>\nFrom: \"Apple\" <help@apple.com>\nReturn-Path: <b@#h#>\nSubject:\n"
    "Message-ID: <#k#@mx.#h#>\nDate: today\nReceived-SPF: SoftFail (x)\nX-Spam-Status: Yes, hits=#k#\n\nA penalty applies.",
    "From: x@qqzzk.example\nAuthentication-Results: mx; spf=permerror; dkim=neutral\nARC-Authentication-Results: dmarc=pass\n"
    "not a header: #k#\nrest of it ñfine; fine",
    "Subject: only one header\nhello #k#",
    "Your parcel EV#k# is held.\tA small customs fee is due. Pay at #h#/pay or tap this link here",
    "I am the director. Keep this between us. A wire transfer of #k# is overdue; don't tell anyone, you will be fined.",
]

TEMPLATES = [GOLDEN[g] for g in GOLDEN_IDS] + _NOTES + [f"{text} Ref #k# #h#." for text, _ in PROBES]


def _rename(df, source, number, ts, raw):
    """Keys of the four tables are interleaved, so that they cannot meet."""
    offset = ["orders", "documents", "pages", "conversations"].index(source)
    return df.select((number.cast("bigint") * 4 + offset).alias("msg_id"),
                     ts.cast("timestamp").alias("ts"), F.lit(source).alias("source"), raw.alias("raw"))


def mails_of(orders):
    """One mail per order of a table or a stream. The two lookup tables have a fixed, small number of rows."""
    spark = orders.sparkSession
    templates = spark.createDataFrame(list(enumerate(TEMPLATES)), "template_id int, template string")
    hosts = spark.createDataFrame(list(enumerate(HOSTS)), "host_id int, host string")
    joined = (orders
              .join(F.broadcast(templates), F.expr(f"o_orderkey % {len(TEMPLATES)} = template_id"))
              .join(F.broadcast(hosts), F.expr(f"o_custkey % {len(HOSTS)} = host_id")))
    raw = F.expr("replace(replace(template, '#k#', cast(o_orderkey as string)), '#h#', host)")
    return _rename(joined, "orders", F.col("o_orderkey"), F.col("o_orderdate"), raw)


ORDER_BYTES = 32 * 1024  # of orders per task: a mail is made of one, and is many times as long


def orders_of(spark, sf_dir):
    """Keys of the orders, spread over tasks while they are still narrow."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    return spread(orders, "o_orderkey", ORDER_BYTES)


def mails(spark, sf_dir):
    return mails_of(orders_of(spark, sf_dir))


def golden_mails(spark, sf_dir):
    """The mails that are golden ones; others are not even built."""
    golden = spark.createDataFrame([(i,) for i in range(len(GOLDEN_IDS))], "template_id int")
    return mails_of(orders_of(spark, sf_dir).join(
        F.broadcast(golden), F.expr(f"o_orderkey % {len(TEMPLATES)} = template_id"), "left_semi"))


def golden_expectation(spark, sf_dir):
    """What is expected of every order that became a golden mail, keyed by msg_id."""
    expected = spark.createDataFrame(
        [(i, g, *GOLDEN_EXPECTED[g]) for i, g in enumerate(GOLDEN_IDS)],
        "template_id int, golden string, expected_band string, min_score int, max_score int, expected_raw int")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return (orders.join(F.broadcast(expected), F.expr(f"o_orderkey % {len(TEMPLATES)} = template_id"))
            .withColumn("msg_id", F.col("o_orderkey").cast("bigint") * 4).drop("o_orderkey", "template_id"))


def messages(spark, sf_dir):
    """All messages of a data directory: (msg_id, ts, source, raw)."""
    read = lambda name, key, *columns: spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, *columns), key)
    never = F.lit(None)
    documents = _rename(read("documents", "doc_id", "text"), "documents", F.col("doc_id"), never, F.col("text"))
    pages = _rename(read("pages", "page_id", "html"), "pages", F.col("page_id"), never, F.col("html"))
    talks = _rename(read("conversations", "conv_id", "turn", "text"), "conversations",
                    F.col("conv_id") * 10000 + F.col("turn"), never, F.col("text"))
    return mails(spark, sf_dir).unionByName(documents).unionByName(pages).unionByName(talks)


def page_links(spark, sf_dir):
    """The address of every page as a message of its own."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.col("page_id").alias("msg_id"), F.col("url").alias("raw"))
