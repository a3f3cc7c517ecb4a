"""Lookup lists of the triage rules.

FIXED VALUES: every list below must hold exactly these entries, in this order,
for scores to come out right (first match wins for brands).
"""

MULTI_PART_SUFFIXES = [
    "co.uk", "org.uk", "me.uk", "ltd.uk", "plc.uk", "gov.uk", "ac.uk", "net.uk", "sch.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "net.nz", "org.nz",
    "co.za", "org.za", "co.in", "net.in", "org.in", "co.jp", "ne.jp", "or.jp",
    "com.br", "net.br", "org.br", "com.mx", "com.ar", "com.tr", "com.sg", "com.hk",
    "com.cn", "com.tw", "com.my", "com.ph", "com.vn", "co.kr", "co.id", "co.il", "co.th",
]

COMMON_TLDS = [
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io",
    "co", "me", "tv", "cc", "app", "dev", "ly", "to", "ai", "us", "uk", "ca", "au", "de",
    "fr", "jp", "cn", "ru", "br", "in", "nl", "it", "es", "se", "no", "eu", "ch", "pl", "be",
    "at", "dk", "fi", "gr", "pt", "ie", "hk", "sg", "my", "ph", "th", "vn", "id", "pk", "ng",
    "ke", "eg", "sa", "tr", "ar", "cl", "pe", "mx", "za", "nz", "cz", "ro", "hu", "sk", "bg",
]

RISKY_TLDS = [
    "tk", "ml", "ga", "cf", "gq", "xyz", "top", "icu", "click", "link", "work", "buzz",
    "rest", "country", "stream", "download", "loan", "gdn", "bid", "win", "mom", "party",
    "review", "science", "zip", "mov", "kim", "su", "pw", "cc", "ws", "live", "online",
    "site", "info", "biz", "best", "cfd", "sbs", "cyou", "monster", "quest", "bar", "shop",
    "club", "support", "help", "services", "email", "today", "life", "world", "space",
]

SHORTENERS = [
    "bit.ly", "bitly.com", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly",
    "rebrand.ly", "cutt.ly", "shorturl.at", "rb.gy", "tiny.cc", "lnkd.in", "s.id",
    "shorte.st", "adf.ly", "bl.ink", "clck.ru", "v.gd", "urlz.fr", "short.gy", "t.ly",
    "cutt.us", "soo.gd", "x.co", "mcaf.ee", "qr.ae", "u.to", "snip.ly", "short.io",
]

FREE_MAIL_DOMAINS = [
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "hotmail.co.uk",
    "live.com", "live.co.uk", "msn.com", "yahoo.com", "yahoo.co.uk", "ymail.com",
    "aol.com", "gmx.com", "gmx.de", "mail.com", "zoho.com", "protonmail.com",
    "proton.me", "yandex.com", "yandex.ru", "mail.ru", "inbox.com", "icloud.com", "me.com",
]

# (name, tokens, registrable domains)
BRANDS = [
    ("Microsoft", ["microsoft", "office365", "microsoft365", "onedrive", "sharepoint", "outlook", "msonline"],
     ["microsoft.com", "office.com", "office365.com", "microsoft365.com", "microsoftonline.com",
      "sharepoint.com", "outlook.com", "live.com", "azure.com"]),
    ("Apple", ["apple", "icloud", "appleid", "itunes"], ["apple.com", "icloud.com", "itunes.com"]),
    ("Google", ["google", "gmail", "googlemail", "youtube"],
     ["google.com", "gmail.com", "googlemail.com", "youtube.com"]),
    ("PayPal", ["paypal"], ["paypal.com", "paypal.co.uk", "paypal.me"]),
    ("Amazon", ["amazon", "amazonprime"],
     ["amazon.com", "amazon.co.uk", "amazon.co.jp", "aws.amazon.com"]),
    ("Netflix", ["netflix"], ["netflix.com"]),
    ("Meta / Facebook", ["facebook", "instagram", "whatsapp"],
     ["facebook.com", "meta.com", "instagram.com", "whatsapp.com"]),
    ("LinkedIn", ["linkedin"], ["linkedin.com", "lnkd.in"]),
    ("Dropbox", ["dropbox"], ["dropbox.com"]),
    ("Adobe", ["adobe", "acrobat"], ["adobe.com"]),
    ("DocuSign", ["docusign"], ["docusign.com", "docusign.net"]),
    ("Bank of America", ["bankofamerica"], ["bankofamerica.com"]),
    ("Chase", ["chase", "jpmorgan"], ["chase.com", "jpmorgan.com"]),
    ("Wells Fargo", ["wellsfargo"], ["wellsfargo.com"]),
    ("Barclays", ["barclays"], ["barclays.co.uk", "barclays.com"]),
    ("HSBC", ["hsbc"], ["hsbc.com", "hsbc.co.uk"]),
    ("Lloyds Bank", ["lloyds", "lloydsbank"], ["lloydsbank.com", "lloydsbank.co.uk"]),
    ("NatWest", ["natwest"], ["natwest.com", "natwest.co.uk"]),
    ("Santander", ["santander"], ["santander.com", "santander.co.uk"]),
    ("Nationwide", ["nationwide"], ["nationwide.co.uk"]),
    ("Revolut", ["revolut"], ["revolut.com"]),
    ("Wise", ["wise", "transferwise"], ["wise.com", "transferwise.com"]),
    ("Coinbase", ["coinbase"], ["coinbase.com"]),
    ("Binance", ["binance"], ["binance.com"]),
    ("Steam", ["steam", "steampowered"], ["steampowered.com", "steamcommunity.com"]),
    ("Spotify", ["spotify"], ["spotify.com"]),
    ("DHL", ["dhl"], ["dhl.com", "dhl.co.uk", "dhl.de"]),
    ("FedEx", ["fedex"], ["fedex.com"]),
    ("UPS", ["unitedparcel"], ["ups.com"]),
    ("USPS", ["usps"], ["usps.com", "usps.gov"]),
    ("Royal Mail", ["royalmail"], ["royalmail.com", "royalmail.co.uk"]),
    ("Evri", ["evri", "myhermes"], ["evri.com", "myhermes.co.uk"]),
    ("DPD", ["dpd"], ["dpd.com", "dpd.co.uk", "dpdlocal.co.uk"]),
    ("HMRC", ["hmrc"], ["hmrc.gov.uk", "gov.uk"]),
    ("IRS", ["irs"], ["irs.gov"]),
    ("eBay", ["ebay"], ["ebay.com", "ebay.co.uk"]),
    ("Visa", ["visa"], ["visa.com", "visa.co.uk"]),
    ("Mastercard", ["mastercard"], ["mastercard.com", "mastercard.co.uk"]),
    ("Airbnb", ["airbnb"], ["airbnb.com", "airbnb.co.uk"]),
    ("Booking.com", ["booking"], ["booking.com"]),
    ("Uber", ["uber"], ["uber.com"]),
    ("Xbox", ["xbox"], ["xbox.com"]),
    ("PlayStation", ["playstation"], ["playstation.com"]),
]

HOST_STOPWORDS = [
    "example", "sample", "test", "demo", "local", "localhost", "invalid",
    "mail", "email", "smtp", "webmail", "portal", "login", "signin", "account", "secure",
    "security", "verify", "verification", "update", "support", "service", "services",
    "tracking", "delivery", "parcel", "invoice", "billing", "notice", "alert", "message",
]

# group -> extensions; groups are tested in the order executable, disk_image, macro, archive, unusual
EXTENSION_GROUPS = {
    "executable": ["exe", "scr", "js", "jse", "vbs", "vbe", "wsf", "wsh", "hta", "bat", "cmd", "pif",
                   "ps1", "psm1", "jar", "lnk", "msi", "reg", "chm", "apk", "dll", "cpl", "url", "sct",
                   "xnk", "iqy", "slk"],
    "disk_image": ["iso", "img", "vhd", "vhdx", "vmdk", "udf"],
    "archive": ["zip", "rar", "7z", "tar", "gz", "cab", "ace", "arj", "lzh"],
    "macro": ["docm", "dotm", "xlsm", "xltm", "xlsb", "pptm", "potm", "ppam", "xlam", "sldm"],
    "unusual": ["rtf", "svg", "html", "htm", "mht", "eml", "msg", "wiz", "doc", "xls"],
}
HARMLESS_EXTENSIONS = ["pdf", "docx", "xlsx", "pptx", "csv", "txt", "png", "jpg", "jpeg"]

# Pairs that make a double extension: a document-like name in front of a runnable or packed one.
DOUBLE_EXTENSION_FIRST = ["pdf", "doc", "docx", "xls", "xlsx", "jpg", "jpeg", "png", "txt", "csv", "html", "htm"]
DOUBLE_EXTENSION_LAST = ["exe", "scr", "js", "vbs", "bat", "cmd", "pif", "lnk", "hta", "iso", "zip", "rar"]

STRONG_HEADERS = [
    "received", "return-path", "from", "reply-to", "subject",
    "message-id", "authentication-results", "dkim-signature", "received-spf",
    "sender", "delivered-to", "envelope-to", "x-spam-flag", "x-spam-status",
]

# Presence of one of these makes a header block look like a full raw message.
FULL_MESSAGE_HEADERS = ["received", "return-path", "authentication-results",
                        "dkim-signature", "mime-version", "content-type"]

CATEGORY_ORDER = [
    "Credentials", "Pressure tactics", "Money and payments", "Impersonation",
    "Links and actions", "Attachments", "Message source", "Email headers", "Authentication",
    "Combination of findings",
]

# severity -> (rank the sort really uses, rank the documentation promises)
SEVERITIES = {"critical": (9, 0), "high": (1, 1), "medium": (2, 2), "low": (3, 3), "info": (4, 4)}

MAX_CHARACTERS = 300_000
MAX_SCORE = 100


def all_tlds():
    """Common and risky suffixes, each once."""
    return list(dict.fromkeys(COMMON_TLDS + RISKY_TLDS))


def all_extensions():
    """Every extension that makes a word look like a file name, each once."""
    grouped = [e for exts in EXTENSION_GROUPS.values() for e in exts]
    return list(dict.fromkeys(grouped + HARMLESS_EXTENSIONS))
