"""Rule catalogue: 59 weighted rules kept as data.

FIXED VALUES: ids, categories, severities, points, titles, advice, patterns,
combination sets, bands, labels, notes and recommendation texts must hold
exactly these values, in this order, for results to come out right. The
rationale of a rule (``why``) and the band blurbs are this project's own words.

Patterns are written case-insensitive with ``\\b``, ``\\s`` and ``\\w`` in their
ASCII / wide-whitespace meaning; ``mailsift.functions.regex`` renders them for
the JVM.
"""

from collections import namedtuple

Rule = namedtuple("Rule", "rule_id source category severity points title why advice patterns")
Rule.__new__.__defaults__ = ((),)

CRED, PRESSURE, MONEY, IMPERSONATION = "Credentials", "Pressure tactics", "Money and payments", "Impersonation"
LINKS, FILES, SOURCE = "Links and actions", "Attachments", "Message source"
HEADERS, AUTH, COMBINED = "Email headers", "Authentication", "Combination of findings"

TEXT_RULES = [
    Rule("password_request", "body", CRED, "critical", 18, "Asks for a password",
         "Mail that asks for a password is almost always after the account.",
         "Never enter a password reached from an email link. If you are worried, open the service by typing its address yourself or use its official app.",
         [r"\b(?:enter|provide|confirm|verify|update|re-?enter|send|submit|type|share|supply|validate)\b[^.!?\n]{0,45}\bpassword\b",
          r"\bpassword\b[^.!?\n]{0,45}\b(?:verify|confirm|reset|update|continue|restore|unlock|expire)",
          r"\b(?:username|user id|login)\b\s*(?:and|&)\s*(?:password|passphrase)\b",
          r"\bcurrent password\b",
          r"\bchange your password\b[^.!?\n]{0,40}\b(?:click|here|link|immediately|now)"]),
    Rule("mfa_code_request", "body", CRED, "critical", 16, "Asks for a one-time / verification code",
         "A one-time code is half of a login; whoever asks for it is trying to finish signing in.",
         "Treat any request for a login or verification code as hostile. Never share it, even with someone who claims to be from IT support.",
         [r"\b(?:one[- ]time|otp|verification|security|authentication|2fa|mfa|login|sign[- ]?in|sms)\s*code\b",
          r"\b(?:6|six)[- ]digit code\b",
          r"\benter the code\b",
          r"\bshare (?:the |this |your )?(?:code|otp|pin)\b",
          r"\bcode (?:you|that you|which you)(?:'ve| have)? just received\b",
          r"\bapprove the (?:sign[- ]?in|login|request|push notification)\b"]),
    Rule("credential_harvesting", "body", CRED, "high", 12, 'Credential-harvesting language ("verify your account")',
         "Wording like this supplies a reason to visit a fake login page.",
         "Do not follow the email to a login page. Sign in through the official app or website instead, and check there whether the alert is genuine.",
         [r"\b(?:verify|confirm|validate|update|restore|reactivate|unlock|secure|upgrade)\s+(?:your\s+)?(?:account|identity|credentials|login|sign[- ]?in|details|information|profile|mailbox)\b",
          r"\bsign in to (?:verify|confirm|restore|unlock|reactivate)\b",
          r"\bre-?authenticate\b",
          r"\bclick (?:here|below|the link)\b[^.!?\n]{0,30}\b(?:verify|confirm|restore|unlock|update|secure)\s+(?:your\s+)?(?:account|identity|login|sign[- ]?in|credentials|details|information|profile|mailbox)\b",
          r"\baccount (?:verification|validation|confirmation)\b",
          r"\bconfirm your identity\b"]),
    Rule("account_threat", "body", PRESSURE, "high", 14, "Threatens to suspend, close or lock the account",
         "The fear of losing an account is a common lever to make people act.",
         "Slow down. Check the claim by logging in through the official app or website, then contact the organisation through a channel you already trust.",
         [r"\b(?:account|mailbox|profile|subscription|service|access)\b[^.!?\n]{0,45}\b(?:suspend|suspension|terminat\w*|clos(?:e|ed|ure)|deactivat\w*|disabl\w*|blocked|locked|restricted|deleted|expir\w*)",
          r"\bwill be (?:suspend\w*|clos\w*|deactivat\w*|terminat\w*|delet\w*|locked)\b",
          r"\bpermanently (?:suspend\w*|clos\w*|delet\w*|block\w*|lock\w*)\b",
          r"\blose (?:access|your account|all your)\b",
          r"\bwithin \d+\s*(?:hours?|hrs?|days?|minutes?)\b[^.!?\n]{0,45}\b(?:or|otherwise|fail\w*|risk\w*)"]),
    Rule("urgency_pressure", "body", PRESSURE, "medium", 10, "Urgency and pressure language",
         "Deadlines are used to stop a reader from checking; honest reminders use them too.",
         "Give yourself a minute. A genuine organisation will still be there tomorrow, and you can verify the message at your own pace.",
         [r"\b(?:immediate(?:ly)?|urgent(?:ly)?|as soon as possible|asap|right away|without delay|prompt action|act now|time[- ]sensitive|final (?:notice|warning|reminder|chance)|last (?:chance|warning|reminder)|expires? (?:today|soon|tonight|in \d+)|don'?t (?:delay|ignore|wait))\b",
          r"\bwithin the next \d+\s*(?:hours?|hrs?|minutes?|days?)\b",
          r"\b\d{1,3}\s*(?:hours?|hrs?|minutes?)\b[^.!?\n]{0,25}\b(?:to (?:respond|act|comply|verify|confirm|pay)|remaining)\b"]),
    Rule("secrecy_request", "body", PRESSURE, "medium", 8, "Asks you to keep it secret or not tell anyone",
         "Fraud against businesses depends on nobody else being asked.",
         "Treat secrecy requests as a red flag and discuss the message with a colleague or your security team before acting.",
         [r"\b(?:do not|don'?t|please don'?t|kindly do not|never)\s+(?:tell|inform|discuss|share|mention|notify|contact)\b",
          r"\bkeep (?:this|it)\s+(?:confidential|private|between us|secret|quiet)\b",
          r"\bconfidential (?:matter|transaction|business|request)\b",
          r"\bthis is (?:a )?(?:strictly )?confidential\b"]),
    Rule("unusual_payment", "body", MONEY, "critical", 16, "Payment requested by gift card, voucher, wire transfer or crypto",
         "These ways to pay cannot be reversed or traced.",
         "Stop. Do not buy gift cards and do not send money. Verify the request by phoning the person or organisation on a number you already have.",
         [r"\bgift ?cards?\b",
          r"\b(?:itunes|google play|amazon|steam|apple|walmart|target|vanilla|sainsbury'?s|tesco|prepaid)\b[^.!?\n]{0,25}\b(?:card|voucher|code)\b",
          r"\b(?:wire transfer|bank transfer|money transfer)\b",
          r"\b(?:western union|moneygram)\b",
          r"\b(?:cryptocurrency|bitcoin|btc|ethereum|usdt|crypto wallet)\b",
          r"\brecharge (?:card|voucher)\b"]),
    Rule("bank_details_change", "body", MONEY, "critical", 15, "Asks to change bank or payment details",
         "Swapping the payee account is how invoice fraud diverts a real payment.",
         "Never change payment details based on an email. Confirm the new details using a phone number you already have on file.",
         [r"\b(?:update|change|amend|revise|correct|replace)\b[^.!?\n]{0,35}\b(?:bank|payment|remittance|billing|account)\s*(?:details|information|instructions|number)\b",
          r"\bnew (?:bank|account|payment) details\b",
          r"\bupdated (?:banking|bank|payment|remittance)\s*(?:details|instructions|information)\b",
          r"\bchange of (?:bank|banking|payment) details\b",
          r"\bnew (?:sort code|iban|account number|routing number|bsb)\b",
          r"\bremittance (?:details|instructions|advice)\b"]),
    Rule("unexpected_invoice", "body", MONEY, "medium", 9, "Unexpected invoice or overdue-payment language",
         "A bill nobody expected is a warning sign more often than a reminder.",
         "Check the invoice against your own records before doing anything, and contact the supplier using contact details you already have.",
         [r"\b(?:outstanding|unpaid|overdue|due) (?:invoice|payment|balance|amount|bill)\b",
          r"\bplease find (?:attached|enclosed)\b[^.!?\n]{0,35}\binvoice\b",
          r"\binvoice (?:is )?attached\b",
          r"\bpay the (?:attached|enclosed|outstanding) invoice\b",
          r"\bpayment (?:is )?(?:overdue|now due|past due|required)\b"]),
    Rule("bec_authority", "body", IMPERSONATION, "high", 12, "Impersonates an executive or an authority figure",
         "Speaking as a boss or an official makes people act without asking.",
         "Verify the request in person or by calling a number you already have. Never rely on contact details supplied inside the message.",
         [r"\b(?:chief executive|ceo|cfo|coo|managing director|finance director|your boss|the director|head of (?:finance|department|accounts))\b",
          r"\b(?:i am|this is)\s+(?:the\s+)?(?:ceo|director|it (?:department|support|helpdesk|team)|system administrator|administrator|hr department)\b",
          r"\bon behalf of\b[^.!?\n]{0,30}\b(?:ceo|cfo|director|management|executive)\b",
          r"\b(?:hmrc|irs|tax (?:office|authority|department)|law enforcement|police|interpol)\b[^.!?\n]{0,30}\b(?:action|case|investigation|refund|notice|penalty|arrest)"]),
    Rule("generic_impersonation", "body", IMPERSONATION, "medium", 8, "Impersonates a brand or support team in general terms",
         "A nameless team of a well-known company is typical of bulk fraud.",
         "Ignore the claim of identity inside the email and verify the message through the official website or app.",
         [r"\b(?:microsoft|apple|google|paypal|amazon|netflix|barclays|hsbc|lloyds|natwest|santander|dhl|fedex|ups|dpd|hmrc|facebook|instagram)\b[^.!?\n]{0,25}\b(?:support|security team|customer (?:service|care)|service team|helpdesk|account team|team)\b",
          r"\b(?:your|the)\s+(?:it\s+|technical\s+|tech\s+)?(?:support|helpdesk|help desk|service desk|security|billing|account|fraud)\s+(?:team|department|desk)\b",
          r"\bwe are (?:your|the)\s+(?:bank|provider|service provider|account team)\b"]),
    Rule("generic_greeting", "body", IMPERSONATION, "low", 5, "Generic greeting instead of your name",
         "The sender may hold addresses but no names; a weak clue by itself.",
         "Treat this as one small clue rather than a conclusion, and weigh it with the other findings.",
         [r"\b(?:dear|hello|hi|attention)\s+(?:customer|user|member|client|valued (?:customer|client)|account holder|sir\/madam|friend)\b",
          r"\bdear (?:all|colleague|staff)\b"]),
    Rule("security_alert_language", "body", PRESSURE, "high", 10, "Claims a suspicious sign-in or compromised activity",
         "An invented alarm pushes the reader to log in on the attacker's page.",
         "Open the service directly through its official app or by typing the address yourself, and check for genuine security alerts there.",
         [r"\b(?:unusual|suspicious|unrecognized|unrecognised|unauthorised|unauthorized|malicious)\s+(?:sign[- ]?in|login|log[- ]?in|activity|access|device|attempt)\b",
          r"\bwe (?:detected|noticed|blocked|observed)\b[^.!?\n]{0,40}\b(?:activity|attempt|sign[- ]?in|login|access)\b",
          r"\byour account (?:has been|was|is|will be)\s+(?:compromised|locked|suspended|accessed|at risk)\b",
          r"\bsecurity alert\b",
          r"\bunusual (?:account )?activity\b"]),
    Rule("click_inducement", "body", LINKS, "medium", 8, "Pushes you to click a link, open an attachment or scan a code",
         "The message asks for the one action that starts most attacks.",
         "Do not click or scan. Navigate to the service yourself using a bookmark, the official app, or an address you type by hand.",
         [r"\b(?:click|tap|follow|use|visit)\s+(?:on\s+)?(?:the |this |that )?(?:link|button|url)\s*(?:below|here|to|above|provided)?\b",
          r"\blog ?in (?:here|below|now|to your account)\b",
          r"\bsign ?in (?:here|below|now|to your account)\b",
          r"\b(?:open|view|download|check)\s+(?:the\s+)?(?:attached|attachment|enclosed)\s*(?:document|file|invoice|report|copy)?\b",
          r"\bscan (?:the )?(?:qr|bar)\s?code\b"]),
    Rule("macro_request", "body", FILES, "high", 14, "Asks you to enable macros, editing or content",
         "Enabling content switches off the protection that stops macro malware.",
         "Do not enable macros or content in a document that arrived by email. If a document genuinely needs macros, ask the sender directly.",
         [r"\b(?:enable|allow|turn on|activate)\s+(?:editing|content|macros?|active content|external content)\b",
          r'\bclick\s+"?enable (?:content|editing|macros?)"?\b',
          r"\b(?:disable|turn off)\s+(?:protected view|security (?:settings|warnings?))\b",
          r"\btrust(?:ed)? (?:center|centre)\b",
          r"\bprotected view\b",
          r"\bmacros?\b[^.!?\n]{0,30}\b(?:required|enable|disabled|blocked|run)\b"]),
    Rule("delivery_scam", "body", IMPERSONATION, "medium", 8, "Parcel or delivery problem that needs your action",
         "Nearly everyone expects a parcel, which makes this lure work.",
         "Track parcels only on the courier’s own website or app, using a tracking number from your original order confirmation.",
         [r"\b(?:parcel|package|shipment|delivery|consignment|item)\b[^.!?\n]{0,45}\b(?:held|waiting|awaiting|failed|unable to (?:deliver|be delivered)|undeliverable|on hold|rescheduled|returned to sender|customs|fee|outstanding|tried to deliver)\b",
          r"\bmissed (?:delivery|parcel|shipment)\b",
          r"\b(?:reschedule|redeliver|re-?arrange)\b[^.!?\n]{0,35}\b(?:delivery|parcel|shipment)\b",
          r"\b(?:small|processing|redelivery|handling|customs)\s*fee\b"]),
    Rule("threat_of_financial_loss", "body", PRESSURE, "medium", 9, "Threatens a penalty, fine, charge or legal consequence",
         "Legal and money threats are meant to cause panic.",
         "Contact the organisation or authority using contact details from their official website before responding in any way.",
         [r"\b(?:penalty|fine|surcharge|legal action|prosecut\w*|court (?:action|proceedings)|arrest|seizure)\b",
          r"\byou (?:will|may|must)\s+(?:be|face|pay)\b[^.!?\n]{0,30}\b(?:charged|fined|penalised|penalized|prosecuted|liable)",
          r"\b(?:unpaid|outstanding)\b[^.!?\n]{0,25}\b(?:debt|tax|fine|penalty|balance)\b[^.!?\n]{0,45}\b(?:action|legal|enforcement|court)"]),
]

LINK_RULES = [
    Rule("ip_address_url", "url", LINKS, "high", 12, "Link uses a raw IP address",
         "Real services publish names; a bare number suggests throw-away hosting.",
         "Do not visit the address. If the message claims to be from a company, contact them through their official site instead."),
    Rule("shortened_url", "url", LINKS, "medium", 8, "Shortened link hides its destination",
         "The reader cannot see where a shortened link ends up.",
         "Do not click it. If the message matters, ask the sender for the full address or find the page yourself."),
    Rule("risky_tld", "url", LINKS, "medium", 10, "Link uses a high-risk domain suffix",
         "Cheap suffixes are recycled by short-lived campaigns; a supporting clue.",
         "Read the whole address carefully and ask whether you would expect this organisation to use that kind of domain at all."),
    Rule("brand_lookalike_domain", "url", LINKS, "high", 12, "Link uses a brand name it does not own",
         "The host names a brand but is registered by somebody else.",
         "Never sign in through this link. Open the service from your own bookmark, the official app, or an address you type by hand."),
    Rule("typosquat_domain", "url", LINKS, "high", 12, "Link is a near-miss copy of a real domain",
         "One or two changed characters are enough to fool a quick look.",
         "Never sign in through this link. Compare the address letter by letter with the organisation’s published domain."),
    Rule("homoglyph_domain", "url", LINKS, "high", 10, "Link uses look-alike characters in the domain",
         "Letters of other alphabets can look the same as Latin ones.",
         "Do not trust a link whose address you cannot read character by character. Reach the organisation through a route you control."),
    Rule("many_subdomains", "url", LINKS, "medium", 6, "Link buries the real domain behind many subdomains",
         "A long chain of labels pushes the owner's domain out of sight.",
         "Read the address from the right-hand side to find the domain that actually owns the page."),
    Rule("at_sign_in_url", "url", LINKS, "high", 12, 'Link uses the "@" trick to look trustworthy',
         "Text in front of an at sign is not the host, though it looks like it.",
         "Do not click it. Treat the link as hostile and verify the message another way."),
    Rule("no_https", "url", LINKS, "low", 5, "Link does not use HTTPS",
         "An unencrypted link can be read or changed on the way.",
         "Be cautious about entering any information on an unencrypted page."),
    Rule("nonstandard_port", "url", LINKS, "medium", 6, "Link uses an unusual port number",
         "An explicit odd port hints at a temporary server.",
         "Do not visit it; report the message instead."),
    Rule("encoded_url_chars", "url", LINKS, "medium", 6, "Link contains heavily encoded characters",
         "Percent codes can hide what a link really says.",
         "Do not click it. Ask the sender for a plain description of the page instead."),
]

ATTACHMENT_RULES = [
    Rule("executable_attachment", "attachment", FILES, "critical", 18, "Executable attachment",
         "A file of this type runs code as soon as it is opened.",
         "Do not open it. Delete or report the message, even if you were expecting a document from that person."),
    Rule("disk_image_attachment", "attachment", FILES, "high", 14, "Disc image attachment (.iso / .img and similar)",
         "A disc image can carry a program past filters and warnings.",
         "Do not mount or open it. Report the message to your IT or security team."),
    Rule("macro_attachment", "attachment", FILES, "high", 14, "Macro-enabled Office attachment",
         "The document looks plain but may hold macros.",
         "Do not enable content. Ask the sender for a PDF or to share the document through a company system instead."),
    Rule("archive_attachment", "attachment", FILES, "medium", 8, "Archive attachment (.zip / .rar and similar)",
         "An archive hides its content from simple scanning, yet is normal in business.",
         "Only open an archive you were genuinely expecting, and check what is inside before running anything."),
    Rule("risky_attachment", "attachment", FILES, "medium", 8, "Attachment type that can carry scripts or content",
         "The format looks harmless but may embed scripts or links.",
         "Treat with caution and verify with the sender through a channel you trust."),
    Rule("double_extension", "attachment", FILES, "critical", 18, "Double-extension filename (e.g. invoice.pdf.exe)",
         "A hidden last extension makes a program look like a document.",
         "Do not open it. This trick has no innocent explanation."),
    Rule("rtl_override_filename", "attachment", FILES, "critical", 18, "Filename uses a text-direction trick",
         "A direction override shows part of the name backwards.",
         "Do not open it. Treat the message as malicious and report it."),
    Rule("unusual_attachment_name", "attachment", FILES, "low", 6, "Unusually generic or random attachment name",
         "Numbered or generic names are typical of automated mailings.",
         "Consider whether you were expecting a file from this sender at all."),
]

HTML_RULES = [
    Rule("hidden_content", "html", SOURCE, "high", 10, "Hidden text or elements in the message source",
         "Invisible content says one thing to filters and another to people.",
         "Treat any message with hidden content as untrustworthy and report it."),
    Rule("embedded_login_form", "html", SOURCE, "critical", 14, "The email itself contains a login form",
         "Whatever is typed into a form in a mail goes to whoever made it.",
         "Never fill in a form inside an email. Go to the service through its official app or a bookmark."),
    Rule("tracking_pixel", "html", SOURCE, "low", 5, "Hidden tracking image (beacon pixel)",
         "A one-pixel image reports that the mail was opened.",
         "Note that this tool did not load the image. Consider blocking remote images in your mail client to prevent this tracking."),
    Rule("entity_obfuscation", "html", SOURCE, "medium", 6, "Heavily obfuscated characters in the source",
         "Long runs of codes hide the text from anyone reading the source.",
         "Do not act on the message until you can see its true content, and report it to your security team."),
    Rule("javascript_href", "html", SOURCE, "high", 12, "Link runs a script instead of opening a page",
         "Such a link runs code in place of opening a page.",
         "Do not click it. Report the message."),
    Rule("data_uri_link", "html", SOURCE, "high", 10, "Link embeds a whole page inside the address (data: URI)",
         "The fake page travels inside the link, so no server can be reported.",
         "Do not click it. This technique has no legitimate place in a normal business email."),
    Rule("misleading_link_text", "html", LINKS, "high", 12, "Link text does not match the real destination",
         "The reader sees one address and is sent to another.",
         "Never sign in through such a link. Reach the service through a route you control."),
    Rule("remote_resources", "html", SOURCE, "info", 0, "Remote images or stylesheets are referenced",
         "Opening the mail will probably fetch content from another host.",
         "Consider blocking remote images in your mail client so that opening a message does not confirm your address is active."),
]

HEADER_RULES = [
    Rule("reply_to_mismatch", "header", HEADERS, "high", 14, "Reply-To points somewhere different from the From address",
         "Answers would go to another mailbox than the one shown.",
         "Do not reply to the message. Contact the organisation using details from their official website."),
    Rule("display_name_spoof", "header", HEADERS, "high", 12, "Display name claims a brand the address does not belong to",
         "Anyone can put a brand in the friendly name.",
         "Always check the actual address, not the name. Then reach the organisation through a route you control."),
    Rule("free_mail_sender", "header", HEADERS, "medium", 10, "Corporate-looking message sent from a free mailbox provider",
         "Companies send from their own domain, not from a consumer mailbox.",
         "Treat the message as unverified and contact the organisation directly."),
    Rule("return_path_mismatch", "header", HEADERS, "medium", 6, "Return-Path domain differs from the From domain",
         "Bounces go elsewhere: a bulk mailer, or a false sender.",
         "Weigh this alongside the other findings rather than treating it as proof."),
    Rule("spf_fail", "header", AUTH, "medium", 8, "SPF failed",
         "The sending computer was not allowed to send for that domain.",
         "Do not trust the sender identity. This is a genuine technical red flag, though forwarding and mailing lists can also cause it."),
    Rule("dkim_fail", "header", AUTH, "medium", 8, "DKIM failed",
         "The signature over the content did not verify.",
         "Treat the content as unverified. Do not click links or open attachments."),
    Rule("dmarc_fail", "header", AUTH, "high", 10, "DMARC failed",
         "The message broke the policy its own From domain publishes.",
         "Treat the message as suspicious. Report it rather than acting on it."),
    Rule("spam_header", "header", HEADERS, "medium", 10, "Marked as spam by the receiving mail system",
         "The receiving system had already filed it as spam.",
         "Do not act on the message. If you are unsure, ask your IT or security team to review it."),
    Rule("message_id_mismatch", "header", HEADERS, "low", 5, "Message-ID domain does not match the sender domain",
         "The id was made under another domain: a weak hint of relayed mail.",
         "A single mismatch means little on its own; weigh it with everything else."),
    Rule("missing_headers", "header", HEADERS, "low", 4, "Standard headers are missing",
         "Ordinary mail carries a date and an id; these were stripped or never made.",
         "Treat the message with caution and verify with the sender."),
]

COMBO_RULES = [
    Rule("combo_credential_link", "combination", COMBINED, "critical", 18,
         "Asks for credentials AND links to a domain that is not the brand’s",
         "A reason to log in plus a fake place to do it.",
         "Treat this message as a phishing attempt. Do not follow the link, and report it to your IT or security team."),
    Rule("combo_pressure_credentials", "combination", COMBINED, "high", 10,
         "Pressure tactics AND a credential request",
         "Pressure stops thought while the login is being asked for.",
         "Slow down deliberately. Nothing genuine requires you to hand over login details under time pressure."),
    Rule("combo_payment_authority", "combination", COMBINED, "high", 10,
         "Payment request AND impersonation of authority",
         "Somebody important asks for money: business mail compromise.",
         "Confirm the request in person or on a number you already have before any money moves."),
    Rule("combo_attachment_macro", "combination", COMBINED, "high", 10,
         "Risky attachment AND a request to enable content",
         "A risky file together with the request to unlock it.",
         "Do not open the attachment and do not enable content. Report the message."),
    Rule("combo_auth_identity", "combination", COMBINED, "high", 8,
         "Email authentication failed AND the sender identity does not add up",
         "Failed checks and a sender that does not fit together.",
         "Do not trust the sender. Report the message and verify any request independently."),
]

# combination -> (any of these, and any of those)
COMBO_CLAUSES = {
    "combo_credential_link": (
        ["password_request", "mfa_code_request", "credential_harvesting", "embedded_login_form"],
        ["brand_lookalike_domain", "typosquat_domain", "homoglyph_domain",
         "ip_address_url", "shortened_url", "at_sign_in_url", "misleading_link_text"]),
    "combo_pressure_credentials": (
        ["password_request", "mfa_code_request", "credential_harvesting"],
        ["urgency_pressure", "account_threat", "threat_of_financial_loss", "security_alert_language"]),
    "combo_payment_authority": (
        ["unusual_payment", "bank_details_change", "unexpected_invoice"],
        ["bec_authority", "generic_impersonation", "display_name_spoof", "free_mail_sender"]),
    "combo_attachment_macro": (
        ["executable_attachment", "macro_attachment", "disk_image_attachment",
         "double_extension", "archive_attachment", "risky_attachment"],
        ["macro_request"]),
    "combo_auth_identity": (
        ["spf_fail", "dkim_fail", "dmarc_fail"],
        ["reply_to_mismatch", "display_name_spoof", "return_path_mismatch",
         "free_mail_sender", "message_id_mismatch"]),
}

ALL_RULES = TEXT_RULES + LINK_RULES + ATTACHMENT_RULES + HTML_RULES + HEADER_RULES + COMBO_RULES
RULE_BY_ID = {r.rule_id: r for r in ALL_RULES}

# Names of the rule sources in the registry.
REGISTRY_SOURCE = {"body": "Message text", "url": "Links", "attachment": "Attachments",
                   "html": "HTML source", "header": "Headers", "combination": "Combination"}

# (id, min score, max score, label, blurb)
BANDS = [
    ("clear", 0, 0, "No Obvious Warning Signs", "No rule matched; that alone does not make the message genuine."),
    ("low", 1, 24, "Low Risk", "A few weak signs, possibly innocent; a short check is worth it."),
    ("medium", 25, 54, "Suspicious", "Several signs or one strong sign; confirm through a trusted channel first."),
    ("high", 55, 100, "High Risk", "The shape of a fraud attempt; do not act on it, report it."),
]

# Link flags in the order they are tested: id -> (tone, label, note). {0}.. are filled in per link.
LINK_FLAGS = {
    "ip_address_url": ("bad", "Raw IP address",
                       "A link that names a raw IP address instead of a domain name rarely belongs to a legitimate business."),
    "shortened_url": ("warn", "Shortened link",
                      "The real destination is hidden behind a shortening service. This tool will not follow it."),
    "risky_tld": ("warn", "High-risk suffix (.{0})",
                  "This suffix is cheap or free to register and is used heavily in short-lived phishing campaigns."),
    "brand_lookalike_domain": ("bad", "Mentions {0} but is not their domain",
                               "The brand name appears in the address, but the domain belongs to someone else. Official {0} mail comes from {1}."),
    "typosquat_domain": ("bad", "Near-miss of {0} ({1})",
                         "The domain is only {2} character(s) away from {1}. That is a classic look-alike address."),
    "homoglyph_domain": ("bad", "Look-alike or non-English characters",
                         "The domain uses characters that resemble ordinary letters, or a punycode form, to imitate a known brand."),
    "many_subdomains": ("warn", "Deep subdomain chain",
                        "Long chains of subdomains push the real domain out of sight, especially on a phone screen."),
    "at_sign_in_url": ("bad", 'Contains "@" before the host',
                       'Text before an "@" is ignored by the browser, so a link can look respectable while sending you somewhere completely different.'),
    "no_https": ("warn", "Not HTTPS",
                 "The link is not encrypted. Login and payment pages should always use HTTPS."),
    "nonstandard_port": ("warn", "Non-standard port :{0}",
                         "Ordinary websites do not ask you to connect on an unusual port number."),
    "encoded_url_chars": ("warn", "Heavily encoded characters",
                          "Long runs of percent-encoded characters can disguise what a link really says."),
    "defanged_link": ("ok", "Written in defanged form (hxxp / [.])",
                      "The text was deliberately broken so it cannot be clicked. It has been inspected as plain text only."),
    "bare_domain": ("ok", "Domain written without a protocol",
                    "This is a bare domain name rather than a full clickable link."),
}

# Zero-point notes: key -> (severity, title, text). {0} is the SPF result.
NOTES = {
    "no_headers": ("info", "No raw email headers found",
                   "This text does not contain a raw header block, so SPF, DKIM, DMARC, Reply-To and Return-Path could not be checked. To include them, open the message in your mail client, choose \"View source\" or \"Show original\", and copy everything."),
    "spf_pass": ("ok", "SPF passed",
                 "The sending system was authorised to send mail for the From domain. That is a positive sign for this message, although a criminal can still pass SPF for a domain they own."),
    "spf_other": ("info", "SPF result: {0}",
                  "SPF did not return a clear pass ({0}). Forwarding and mailing lists often cause this, so on its own it means little."),
    "dkim_pass": ("ok", "DKIM passed",
                  "The message carries a valid cryptographic signature, so its content matches what the signing domain sent."),
    "dmarc_pass": ("ok", "DMARC passed",
                   "The From domain’s own published policy was satisfied. This is the strongest of the three checks."),
    "no_auth": ("info", "No authentication results in these headers",
                "The pasted headers do not include Authentication-Results, so SPF, DKIM and DMARC could not be evaluated at all. Missing results are not evidence of fraud: many providers only add them at the final delivery step."),
}

# Standing advice: key -> (tag, text).
ADVICE = {
    "never_test": ("Do not", "Do not click any link, open any attachment, scan any QR code or reply to this message to find out what it does. Opening it is exactly what the sender wants."),
    "verify": ("Verify", "Verify the message independently: open the organisation’s official app or type its website address yourself, or call a number you already have (never one printed in the message)."),
    "report": ("Report", "Report the message to your IT or security team, or to the organisation it pretends to come from, and then delete it or mark it as spam."),
    "acted_now": ("Act now", "If you already entered details, approved a sign-in, paid money or opened an attachment: change that password immediately, turn on multi-factor authentication, and contact your bank or IT team today. Do not feel embarrassed — speed is what matters."),
    "bank_call": ("Act now", "If this involves a change of bank details or a payment, telephone the supplier or colleague on a number you already have to confirm it, and ask your finance team to hold the payment until it is verified."),
    "macro_care": ("Never", "Never click \"Enable Content\" or \"Enable Editing\" on a document that arrived by email. Ask the sender to share it through a normal business system instead."),
    "quiet": ("Note", "Quiet inboxes are not safe inboxes: this message shows no obvious warning signs, which is not the same as being genuine. Trust your expectations of the sender first."),
    "keep_evidence": ("Keep", "Keep a copy of the message and its headers if your team asks for them. Your pasted text never leaves this page, so the original in your mailbox is the best evidence."),
}
FINDING_ADVICE_TAG = "About this finding"
ADVICE_KEY_LENGTH = 90
MAX_ADVICE = 8

# Indicators that must be present in the registry: (indicator, rule id).
REQUIRED_INDICATORS = [
    ("Urgency and pressure language", "urgency_pressure"),
    ("Threats of account suspension or closure", "account_threat"),
    ("Requests for passwords", "password_request"),
    ("Requests for MFA or verification codes", "mfa_code_request"),
    ("Payment or gift-card requests", "unusual_payment"),
    ("Requests to change bank details", "bank_details_change"),
    ("Suspicious or look-alike URLs", "brand_lookalike_domain"),
    ("Shortened URLs", "shortened_url"),
    ("URLs using raw IP addresses", "ip_address_url"),
    ("Misleading link text", "misleading_link_text"),
    ("Common impersonation language", "generic_impersonation"),
    ("Executive or authority impersonation (BEC)", "bec_authority"),
    ("Unusual attachment filenames", "unusual_attachment_name"),
    ("Executable attachment types", "executable_attachment"),
    ("Requests to enable macros", "macro_request"),
    ("Unexpected invoice language", "unexpected_invoice"),
    ("Credential-harvesting language", "credential_harvesting"),
    ("Sender or Reply-To mismatch", "reply_to_mismatch"),
    ("SPF failures", "spf_fail"),
    ("DKIM failures", "dkim_fail"),
    ("DMARC failures", "dmarc_fail"),
]
