"""Text functions as Spark column expressions. Null texts count as empty unless stated."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a control character, a blank, a Chinese run and a word (fixed values).
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
BLANKS = r"[ \t　]+"
ENDS = r"^[\s\p{Z}\x{85}\x{1C}-\x{1F}]+|[\s\p{Z}\x{85}\x{1C}-\x{1F}]+$"
HAN_RUN, WORD_RUN = r"([一-鿿]+)", r"([A-Za-z0-9]+)"
#: Marks and words between the items of a running text (fixed values).
ITEM_MARKS, ITEM_WORDS = ",，、;；。", ("和", "与", "以及")
#: Digits of a quantity, and the measure and count words that may follow them (fixed values).
QUANTITY_DIGITS = "0-9０-９一二两三四五六七八九十半"
MEASURE_WORDS = (
    "个 颗 根 斤 两 克 公斤 g kg 毫升 ml 升 块 片 只 条 头 瓣 勺 把 份 袋 盒 瓶 碗 杯 支 枚 粒 段 束 扎 包 桶 罐 板 听 捆"
).split()
ITEM_SPLIT = rf"[\s{ITEM_MARKS}]+|{'|'.join(ITEM_WORDS)}"
QUANTITY = f"^([{QUANTITY_DIGITS}]+(?:{'|'.join(MEASURE_WORDS)})?)"
#: Marks after the number of a step, and commas between steps (fixed values).
STEP_MARKS, STEP_COMMAS = ".、．", ",，"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, ENDS, "")


def remove_controls(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), CONTROLS, "")


def clean_text(c: Column | str) -> Column:
    """No control characters, runs of spaces, tabs and ideographic spaces as one space, trimmed; line ends stay."""
    return strip(F.regexp_replace(remove_controls(c), BLANKS, " "))


def clean_lines(c: Column | str) -> Column:
    """Line ends unified, each line cleaned, empty lines dropped."""
    lines = F.split(F.regexp_replace(remove_controls(c), r"\r\n?", "\n"), "\n")
    tidy = F.transform(lines, lambda x: strip(F.regexp_replace(x, BLANKS, " ")))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def strip_markup(c: Column | str) -> Column:
    """Text without script, style, noscript and svg parts, comments and tags."""
    s = F.regexp_replace(_text(c), r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", " ")
    return clean_text(F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " "))


def tokens(c: Column | str) -> Column:
    """Pairs of neighbouring Chinese characters of each run (a single one stays), then lower-case words of letters and digits."""
    runs = F.regexp_extract_all(_text(c), F.lit(HAN_RUN), F.lit(1))
    pairs = F.transform(
        runs,
        lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
        ),
    )
    words = F.transform(F.regexp_extract_all(_text(c), F.lit(WORD_RUN), F.lit(1)), lambda w: F.lower(w))
    return F.concat(F.flatten(pairs), words)


def split_instructions(c: Column | str) -> Column:
    """A running text of steps split at commas and before numbers, numbers taken off, blanks dropped."""
    number = rf"\d+[{STEP_MARKS}]"
    # white space before a number becomes a comma, so that one split does
    marked = F.regexp_replace(strip(_text(c)), rf"(\S)\s+(?={number})", "$1,")
    bare = F.transform(F.split(marked, f"[{STEP_COMMAS}]"), lambda p: strip(F.regexp_replace(p, rf"^\s*{number}", "")))
    return F.filter(bare, lambda p: p != "")


def split_items(c: Column | str) -> Column:
    """(name, quantity) of the items of a free text: split at marks and conjunctions, a leading quantity set apart."""
    parts = F.filter(F.transform(F.split(_text(c), ITEM_SPLIT), strip), lambda p: p != "")
    each = F.transform(
        parts,
        lambda p: F.struct(strip(F.regexp_replace(p, QUANTITY, "")).alias("name"), F.nullif(F.regexp_extract(p, QUANTITY, 1), F.lit("")).alias("quantity")),
    )
    return F.filter(each, lambda x: x["name"] != "")


def csv_values(c: Column | str) -> Column:
    """The trimmed non-empty values of a comma-separated text."""
    return F.filter(F.transform(F.split(_text(c), ","), strip), lambda x: x != "")


def canonical_set(values: Column) -> Column:
    """Cleaned values, each once, in order: a key that doesn't depend on how a set was listed."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), clean_text), lambda x: x != "")))


def sanitized(c: Column | str, most: int) -> Column:
    return F.left(clean_text(c), F.lit(most))


def data_block(*columns: Column | str) -> Column:
    """Compact JSON of ``columns``, nulls written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def source_hash(c: Column | str) -> Column:
    return F.sha2(_text(c), 256)


def fingerprint(address: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.coalesce(address, F.lit("")), F.lit(salt)), 256)


def chunk_id(url: Column, index: Column) -> Column:
    return F.concat_ws("#", source_hash(url), index.cast("string"))


def normal_url(c: Column | str) -> Column:
    """Scheme, host and path of an address, without query and fragment; null for anything else."""
    got = F.regexp_extract(_text(c), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+[^?#]*)", 1)
    return F.nullif(got, F.lit(""))


def absolute_url(href: Column | str, base: Column | str) -> Column:
    """``href`` as an address: as it is where it has a scheme, with the scheme of ``base`` after ``//``, with scheme and host
    of ``base`` where it begins at the root; null for anything else."""
    h, b = strip(_text(href)), _text(base)
    scheme, origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*:)//", 1), F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), h)
        .when(h.startswith("//") & (scheme != ""), F.concat(scheme, h))
        .when(h.startswith("/") & (origin != ""), F.concat(origin, h))
    )


def canonical_url(stated: Column | str, page: Column | str, hosts: list[str]) -> Column:
    """The plain form of the address a page states for itself, else of its own, the first on one of ``hosts``; else null."""
    own = absolute_url(stated, page)
    page = F.col(page) if isinstance(page, str) else page
    return F.coalesce(*(F.when(url_host(u).isin(*hosts), normal_url(u)) for u in (own, page)))


def url_host(c: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_text(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


_BYTE = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IPV4 = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
_GROUP = "[0-9a-f]{1,4}"
_IPV6 = rf"^(?:{_GROUP}:){{7}}{_GROUP}$"


def address_bits(address: Column) -> Column:
    """An IPv4 or IPv6 address as a text of 32 or 128 binary digits; null for anything else.

    In IPv6 one run of zero groups may be left out; addresses with an IPv4 part or a zone are not taken.
    """
    a = F.lower(strip(address))
    four = F.transform(F.split(a, r"\."), lambda x: F.lpad(F.conv(x, 10, 2), 8, "0"))
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    before, after = groups(F.substring_index(a, "::", 1)), groups(F.substring_index(a, "::", -1))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(before) - F.size(after)))
    full = F.when(F.size(F.split(a, "::")) == 2, F.array_join(F.concat(before, zeros, after), ":")).otherwise(a)
    six = F.transform(F.split(full, ":"), lambda x: F.lpad(F.conv(x, 16, 2), 16, "0"))
    return F.when(a.rlike(_IPV4), F.array_join(four, "")).when(full.rlike(_IPV6), F.array_join(six, ""))


def in_networks(address: Column, networks: list[str]) -> Column:
    """Whether an address lies in one of ``networks`` (``10.0.0.0/8``, ``fd00::/8``, or single addresses)."""
    bits, out = address_bits(address), F.lit(False)
    for n in networks:
        net = ipaddress.ip_network(n, strict=False)
        width = net.max_prefixlen
        prefix = format(int(net.network_address), f"0{width}b")[: net.prefixlen]
        out = out | ((F.length(bits) == width) & bits.startswith(prefix))
    return F.coalesce(out, F.lit(False))


def client_address(forwarded: Column, direct: Column, trusted: list[str]) -> Column:
    """The last address of a forwarding list that is in no ``trusted`` network; the direct one where there is none or one
    of them is no address.

    Only requests that come from a trusted proxy are believed.
    """
    hops = F.reverse(csv_values(forwarded))
    valid = F.forall(hops, lambda h: address_bits(h).isNotNull())
    first = F.get(F.filter(hops, lambda h: ~in_networks(h, trusted)), F.lit(0))
    return F.when(in_networks(direct, trusted) & valid, F.coalesce(first, direct)).otherwise(direct)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is null, of another size or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), 1 - dot(a, b) / norms)
