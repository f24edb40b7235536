"""Text functions as Column expressions; Python only where Spark has no expression."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def plain(text: str) -> str:
    """NFC without zero-width characters and soft hyphens."""
    return "".join(c for c in unicodedata.normalize("NFC", text) if c not in ZERO_WIDTH)


# Digit sets, character sets, defaults, and the words and endings that searches treat apart.
BN_DIGITS, ASCII_DIGITS = "০১২৩৪৫৬৭৮৯", "0123456789"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
TOKEN = r"[\p{L}\p{N}_ঀ-৿]+"
CHARS_PER_TOKEN = 2.3
BLOCK_TAGS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "blockquote", "section", "article", "header", "footer", "pre", "hr"}
DROPPED_TAGS = {"script", "style", "noscript", "iframe", "object", "embed", "svg", "img", "head"}
# Fixed values of HTML: elements without content, those that a head holds, and which open elements a start tag ends.
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEAD_TAGS = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Tag to (elements that it ends, elements that these are looked for in).
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}
SECTION_JUNK = "()[]।.:-৷ \u2010\u2011\u2013"
VOLATILE = {"like_user_counter", "share_user_counter", "viewer_counter", "comment_counter", "view_count", "reply_count", "like_count", "member_count", "topic_count"}
BN_STOPWORDS = [*map(plain, """
কি কী কেন কিভাবে কীভাবে কোথায় কখন কোন কোনো কোনটি কে কারা কাকে কার কত কতটি কয়টি কতগুলো
কতদিন কতদিনে কতজন কিনা কি-না কিংবা অথবা বা ও এবং আর যে যা যদি তবে তাহলে তাই সেই এই ওই
এটা এটি ওটা সেটা সেটি ইহা উহা তাহা তা এর এতে এখানে সেখানে আমি আমার আমাদের আপনি আপনার
আপনারা তুমি তোমার সে তার তারা তাদের তিনি তাঁর হয় হবে হলে হলো হল হয়েছে হইবে হইয়াছে হইতে
করা করে করতে করবো করব করবেন করেন করলে করিয়া করিবে করিতে পারি পারব পারবো পারবেন পারে যায়
যাবে যাবেনা দিতে দেয়া দেওয়া নিতে নেয়া লাগে লাগবে প্রয়োজন জন্য জন্যে থেকে হতে দিয়ে নিয়ে
সাথে সঙ্গে মধ্যে উপর নিচে পর আগে না নয় নাই নেই হ্যাঁ জি একটি একটা এক সব সকল সমস্ত
বিষয়ে সম্পর্কে ব্যাপারে দয়া করে অনুগ্রহ প্লিজ চাই চাচ্ছি জানতে জানাবেন বলুন বলবেন আছে আছেন থাকে থাকবে জিনিস আসলে মানে বলতে বোঝায় বুঝায় বোঝানো কাকে বলে
""".split())]
EN_STOPWORDS = "a an the is are was were be to of in on for and or what how when where which who why do does can i my me you your it this that with from by about please tell".split()
SUFFIXES = [*map(plain, "গুলোতে গুলোর গুলির গুলো গুলি দেরকে দের কেই টির টার তেই েরা ের এর য়ের কে তে টি টা রা ে র".split())]
VARIANTS = {plain(k): plain(v) for k, v in {"নাম্বার": "নম্বর", "নাম্বর": "নম্বর", "নং": "নম্বর", "নম্বরে": "নম্বর", "জরীপ": "জরিপ", "রেজিষ্ট্রেশন": "রেজিস্ট্রেশন", "রেজিষ্ট্রি": "রেজিস্ট্রি", "সার্টিফিকেট": "সনদ", "ওয়ারিশান": "ওয়ারিশ", "উত্তরাধিকারী": "ওয়ারিশ", "কী": "কি"}.items()}

#: What NFC may change: marks, conjoining letters, and characters that it replaces on their own.
_NFC = "[\\p{M}\u0340-\u0387\u0958-\u095f\u09dc-\u09df\u0a33-\u0a5e\u0b5c\u0b5d\u0f43-\u0fb9\u1100-\u11ff\u1f71-\u1ffd\u2000\u2001\u2126-\u212b\u2329\u232a\u2adc\uf900-\ufaff\ufb1d-\ufb4e\\x{1d15e}-\\x{1d1c0}\\x{2f800}-\\x{2fa1d}]"


#: What any of these, Bengali and what has no width is among: all but the Latin letters and signs of one code point.
_BEYOND = "[^\\x00-\u00ac\u00ae-\u02ff]"


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def bn_to_ascii_digits(c: Column) -> Column:
    return F.translate(c, BN_DIGITS, ASCII_DIGITS)


def ascii_to_bn_digits(c: Column) -> Column:
    return F.translate(c, ASCII_DIGITS, BN_DIGITS)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def clean_unicode(c: Column) -> Column:
    """NFC without zero-width characters and soft hyphens. Only texts that NFC may change go to Python."""
    return F.when(is_ascii(c), c).otherwise(F.translate(_composed(c), ZERO_WIDTH, ""))


def _composed(c: Column) -> Column:
    return F.coalesce(_nfc(F.when(~is_ascii(c) & c.rlike(_BEYOND) & c.rlike(_NFC), c)), c)


def normalize_whitespace(c: Column) -> Column:
    """Odd spaces to spaces, runs collapsed, none around newlines, at most one empty line, stripped."""
    c = F.translate(c, "\u00a0\u3000\t\r\f\v", "      ")
    c = F.regexp_replace(F.regexp_replace(c, " +", " "), " ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def tokenize(c: Column) -> Column:
    """Lower-case words of letters, digits, underscore and the Bengali block, without lone underscores; spelling
    variants of a word are one. A null text gives null."""
    words = lambda x: F.filter(F.regexp_extract_all(F.lower(x), F.lit(f"({TOKEN})"), F.lit(1)), lambda t: t != "_")
    known = F.create_map(*(F.lit(x) for kv in VARIANTS.items() for x in kv))
    full = F.transform(words(bn_to_ascii_digits(clean_unicode(c))), lambda t: F.when(t.isin(*VARIANTS), F.element_at(known, t)).otherwise(t))
    # what only some texts need is slow: others go round it
    return F.when(is_ascii(c) | ~c.rlike(_BEYOND), words(c)).when(~c.rlike(f"[ঀ-৿{ZERO_WIDTH}]"), words(_composed(c))).otherwise(full)


def lexical_text(c: Column) -> Column:
    """The tokens with a space between: what is indexed, and a question's canonical form."""
    return F.array_join(tokenize(c), " ")


def light_stem(t: Column) -> Column:
    """A Bengali token without its first ending, longest first, that leaves three characters; র goes after a vowel sign only."""
    out = F.when(~t.rlike("[ঀ-৿]"), t)
    for end in SUFFIXES:
        stem = F.substring(t, F.lit(1), F.length(t) - len(end))
        fits = t.endswith(end) & (F.length(t) - len(end) >= 3)
        out = out.when(fits & stem.rlike("[\u09be-\u09cc]$") if end == "র" else fits, stem)
    return out.otherwise(t)


def query_terms(c: Column) -> Column:
    """Distinct terms to look up, in order, without stopwords: `stem:*` for the beginning of longer words, else the word and its stem."""
    words = F.filter(tokenize(c), lambda t: ~t.isin(*BN_STOPWORDS, *EN_STOPWORDS))
    pairs = F.transform(words, lambda t: F.struct(t.alias("t"), light_stem(t).alias("s")))
    terms = F.transform(pairs, lambda p: F.when((F.length(p["s"]) >= 4) & ~p["s"].rlike(r"^\p{Nd}+$"), F.array(F.concat(p["s"], F.lit(":*")))).otherwise(F.array(p["t"], p["s"])))
    return F.array_distinct(F.flatten(terms))


def is_bengali(c: Column) -> Column:
    """At least as many Bengali characters as ASCII letters; true for neither."""
    t = F.coalesce(c, F.lit(""))
    return F.length(F.regexp_replace(t, "[^ঀ-৿]", "")) >= F.length(F.regexp_replace(t, "[^A-Za-z]", ""))


def lexical_coverage(terms: Column, tokens: Column) -> Column:
    """Share of terms that tokens hold; `x:*` asks for a beginning; no terms give 0."""
    stems = F.transform(F.filter(terms, lambda t: t.endswith(":*")), lambda t: F.substring(t, F.lit(1), F.length(t) - 2))
    begun = F.filter(stems, lambda s: F.exists(tokens, lambda k: k.startswith(s)))
    # whole words are matched through a hash set; the slower test runs only where a beginning is asked for
    n = F.size(F.array_intersect(terms, tokens)) + F.when(F.size(stems) > 0, F.size(begun)).otherwise(0)
    return F.when(F.size(terms) > 0, n / F.size(F.array_distinct(terms))).otherwise(0.0)


def token_count(c: Column) -> Column:
    """A token for each 2.3 characters, at least one; none in an empty text."""
    return F.when(F.length(c) > 0, F.greatest(F.lit(1), F.floor(F.length(c) / CHARS_PER_TOKEN))).otherwise(0).cast("long")


def parse_year(c: Column) -> Column:
    y = F.nullif(F.regexp_extract(bn_to_ascii_digits(c), "([0-9]{4})", 1), F.lit("")).cast("int")
    return F.when(y.between(1700, 2200), y)


def normalize_section_number(c: Column) -> Column:
    """ASCII digits, no space, no separators at the ends, nothing from a footnote's bracket on, ASCII capitals; empty and 0 are null."""
    # the footnote's pattern is a fixed value
    junk = "[" + re.escape(SECTION_JUNK).replace("\\ ", " ") + "\\s]"
    s = F.regexp_replace(bn_to_ascii_digits(clean_unicode(c)), rf"^{junk}+|{junk}+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", ""), r"^([0-9]+[A-Za-zক-হ]{0,2})[\[(].*$", "$1")
    s = F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.when(~s.isin("", "0"), s)


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """A JSON text with sorted keys, no spaces and no counters that change by themselves; null for what isn't JSON."""

    def stable(x):
        if isinstance(x, dict):
            return {k: stable(v) for k, v in x.items() if k not in VOLATILE}
        return [stable(v) for v in x] if isinstance(x, list) else x

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(stable(json.loads(x)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return s.map(one)


def source_hash(record: Column, version: str, signature: str = "") -> Column:
    """sha256 of what a record says and how it is processed; counters don't count."""
    return F.sha2(F.concat(F.lit(f"{version}|{signature}|"), canonical_json(record)), 256)


def text_hash(*cols: Column) -> Column:
    """sha256 of the parts with a unit separator between; null parts are empty."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 256)


def html_strip(c: Column) -> Column:
    """Markup out by five replacements, in order: script, style, head, comments, tags."""
    for p in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?is)<head\b.*?</head>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        c = F.regexp_replace(c, p, " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


class _Text(HTMLParser):
    """Text of markup: the open elements are a stack, and a row's text goes to its open cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        #: How many elements were open where a dropped one began.
        self.dropped: int | None = None
        #: How many were open where the outermost row began; its cells' texts, and which of them are open at which depth.
        self.row: int | None = None
        self.cells: list[list[str]] = []
        self.into: list[tuple[int, list[str]]] = []

    def leave(self, depth: int) -> None:
        """End all elements from a depth on, the innermost first."""
        while len(self.open) > depth:
            tag = self.open.pop()
            at = len(self.open)
            if self.dropped is not None:
                self.dropped = None if at == self.dropped else self.dropped
            elif self.row is not None:
                self.into = [c for c in self.into if c[0] < at]
                if at == self.row:
                    told = [t for t in (squeezed(" ".join(c)) for c in self.cells) if t]
                    self.out.append("\n" + " | ".join(told) + "\n" if told else "")
                    self.row = None
            elif tag in BLOCK_TAGS:
                self.out.append("\n")

    def last(self, tags: set[str], within: set[str] = frozenset()) -> int | None:
        """The depth of the innermost open element of these, as far as the innermost of ``within``."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at] in tags:
                return at
            if self.open[at] in within:
                return None
        return None

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.dropped is not None:
            # </head> may be left out: what only a body has ends it
            if self.open[self.dropped] != "head" or tag in HEAD_TAGS:
                if tag not in VOID_TAGS:
                    self.open.append(tag)
                return
            self.leave(self.dropped)
        if tag in ENDS_P and (at := self.last({"p"}, {"td", "th", "table"})) is not None:
            self.leave(at)
        if tag in ENDS and (at := self.last(*ENDS[tag])) is not None:
            self.leave(at)
        if tag in VOID_TAGS:
            if self.row is None:
                self.out.append("\n" if tag == "br" else "\n\n" if tag == "hr" else "")
            return
        at = len(self.open)
        self.open.append(tag)
        if tag in DROPPED_TAGS:
            self.dropped = at
        elif self.row is not None:
            if tag in ("td", "th"):
                self.cells.append([])
                self.into.append((at, self.cells[-1]))
        elif tag == "tr":
            self.row, self.cells, self.into = at, [], []
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in BLOCK_TAGS:
            self.out.append("\n")

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and self.open and self.open[-1] == tag:
            self.leave(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br" and self.dropped is None and self.row is None:
            self.out.append("\n")
        elif tag not in VOID_TAGS and (at := self.last({tag}, {"table"} if tag not in ("table", "body", "html", "div") else frozenset())) is not None:
            # what is dropped is ended by its own end, or by the end of what holds it
            self.leave(at)

    def handle_data(self, data: str) -> None:
        if self.dropped is not None:
            return
        if self.row is None:
            self.out.append(data)
        for _, cell in self.into:
            cell.append(data)


def squeezed(text: str) -> str:
    """One text as clean_unicode and normalize_whitespace make it."""
    text = re.sub(r"[ \t\r\f\v]+", " ", plain(text).replace("\u00a0", " ").replace("\u3000", " "))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def _html_text(x: str | None) -> str | None:
    if not x or "<" not in x:
        return squeezed(html.unescape(x)) if x else x
    p = _Text()
    p.feed(x)
    p.close()
    p.leave(0)
    return squeezed("".join(p.out))


@F.pandas_udf(T.StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    """Clean text of markup: blocks are lines of their own with one empty line between at most, items begin with a dash, a
    row is its cells that have text with bars between; scripts, styles, pictures and embedded things are left out. Text
    without markup has its entities read. Null stays null."""
    return s.map(_html_text)


# What looks like a secret and what stands for it in logs, in this order.
SECRETS = [
    (r"gsk_[A-Za-z0-9]{20,}", "gsk_***"),
    (r"hf_[A-Za-z0-9]{20,}", "hf_***"),
    (r"(?i)\b(bearer\s+)[A-Za-z0-9._\-]+", "$1***"),
    (r"(?i)((?:x-admin-api-key|x-api-key|api[_-]?key|password)\"?\s*[:=]\s*\"?)[^\s\",}]+", "$1***"),
    (r"((?:postgres(?:ql)?(?:\+\w+)?|redis)://[^:/@\s]*:)[^@\s]+@", "$1***@"),
]


def redact_secrets(c: Column) -> Column:
    """Key prefixes, bearer tokens, named keys and passwords in addresses as ***."""
    for pattern, stands in SECRETS:
        c = F.regexp_replace(c, pattern, stands)
    return c
