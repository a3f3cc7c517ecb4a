"""The per-message pipeline.

Every step adds columns to the row of a message, so the whole analysis is one
map over the input: no shuffle, no join, no state. It runs unchanged on a
stream. Columns that a caller does not select are pruned with the work behind
them.
"""

from pyspark.sql import functions as F

from mailsift.operators import attachments, headers, html, messages, scoring, text_rules, urls
from mailsift.operators.rulebook import BUILT_IN


def structure(df, limit=None):
    """What a message consists of: headers, body, links, files, HTML."""
    df = headers.with_sender(headers.with_headers(messages.prepare(df, limit)))
    return html.with_html(attachments.with_files(urls.with_url_flags(urls.with_urls(messages.with_words(df)))))


def find(df, evidence=True, rules=BUILT_IN):
    """All rule findings over the structure, combinations included."""
    df = text_rules.with_text_findings(text_rules.with_text_hits(df, rules), evidence, rules)
    df = attachments.with_attachment_findings(urls.with_url_findings(df))
    df = headers.with_header_findings(html.with_html_findings(df))
    return scoring.with_findings(scoring.with_hosts(df), rules)


def analyse(df, evidence=True, limit=None, rules=BUILT_IN):
    """``messages(msg_id, raw, ...)`` -> one wide row per message with findings, score and band.

    ``rules`` may come from tables (``RuleBook.from_tables``); a row more there is a rule more here.
    """
    return scoring.with_score(find(structure(df, limit), evidence, rules))


VERDICT = ["msg_id", "raw_score", "score", "capped", "band", "n_critical", "n_high", "n_medium", "n_low",
           "n_info", "n_counted", "url_count", "file_count", "headers_found", "html_found"]


def verdict(analysed, *keep):
    """One flat row per message."""
    return analysed.withColumns({"url_count": F.size("urls").cast("bigint"),
                                 "file_count": F.size("files").cast("bigint")}).select(*VERDICT, *keep)
