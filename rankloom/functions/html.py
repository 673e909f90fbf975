"""HTML to text.  Well-formed pages stay in the JVM, odd nesting goes through Arrow."""

from html.entities import html5

from pyspark.sql import Column, functions as F

from .text import bind

# Subtrees whose text is never part of the page text.
SILENT_TAGS = ("script", "style", "template")
CODE_TAGS = ("pre", "code")

COMMENT = r"(?s)<!--.*?-->"
DECLARATION = r"<[!?][^>]*>"
TAG = r"""</?[a-zA-Z][^<>'"]*(?:(?:"[^"]*"|'[^']*')[^<>'"]*)*>"""
NAMED_ENTITY = r"&[A-Za-z][A-Za-z0-9]*;"
NUMBERED_ENTITY = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def subtree(tag: str) -> str:
    """Pattern of one tag with everything up to its first closing tag."""
    return rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>"


def _entity_table() -> Column:
    """Constant map from ``&name;`` to its characters, built from the standard library table."""
    pairs = [f"&{name}\u0002{value}" for name, value in sorted(html5.items()) if name.endswith(";")]
    return F.str_to_map(F.lit("\u0001".join(pairs)), F.lit("\u0001"), F.lit("\u0002"))


def _code_point(entity: Column) -> Column:
    body = F.substring(entity, F.lit(3), F.char_length(entity) - 3)
    number = F.when(
        F.lower(F.left(body, F.lit(1))) == "x", F.conv(F.substring(body, F.lit(2), F.char_length(body)), 16, 10)
    ).otherwise(body).cast("long")
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    wide = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number)), 8, "0")), "UTF-32")
    return F.coalesce(wide, F.lit("\ufffd"))


def decode_entities(text: Column) -> Column:
    """Replace named and numbered character references; ``&amp;`` comes last."""
    def substitute(current, entities, value_of):
        return F.aggregate(entities, current, lambda out, e: F.replace(out, e, value_of(e)))

    def decoded(raw):
        numbered = F.array_distinct(F.regexp_extract_all(raw, F.lit(NUMBERED_ENTITY), F.lit(0)))
        named = F.array_remove(
            F.array_distinct(F.regexp_extract_all(raw, F.lit(NAMED_ENTITY), F.lit(0))), "&amp;"
        )
        # a literal "&amp;lt;" must end as "&lt;", so the ampersand is parked while others change
        parked = F.replace(raw, F.lit("&amp;"), F.lit("\ue000"))
        table = _entity_table()
        out = substitute(parked, named, lambda e: F.coalesce(F.try_element_at(table, e), e))
        out = substitute(out, numbered, _code_point)
        return F.replace(out, F.lit("\ue000"), F.lit("&"))

    return F.when(F.contains(text, F.lit("&")), bind(text, decoded)).otherwise(text)


def _parser_udf(drop: tuple):
    @F.pandas_udf("string")
    def parsed_text(pages):
        import re
        from html.parser import HTMLParser

        class Text(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.open, self.parts = [], []

            def handle_starttag(self, tag, attrs):
                if tag in drop:
                    self.open.append(tag)

            def handle_endtag(self, tag):
                if tag in self.open:
                    while self.open.pop() != tag:
                        pass

            def handle_data(self, data):
                if not self.open:
                    self.parts.append(data)

        def text_of(page):
            if page is None:
                return None
            parser = Text()
            parser.feed(page)
            parser.close()
            return re.sub(r"\s+", " ", " ".join(parser.parts)).strip()

        return pages.map(text_of)

    return parsed_text


def html_text(html: Column, drop: tuple = CODE_TAGS) -> Column:
    """Visible text of an HTML string: code subtrees out, pieces joined by one blank.

    Pages whose dropped tags are nested or left open cannot be cut by a pattern; only
    those are handed to an Arrow helper around the standard library parser.
    """
    dropped = (*SILENT_TAGS, *drop)
    odd = F.lit(False)
    for tag in dropped:
        opens = F.regexp_count(html, F.lit(rf"(?i)<{tag}(?:\s[^>]*)?>"))
        closes = F.regexp_count(html, F.lit(rf"(?i)</{tag}\s*>"))
        whole = F.regexp_count(html, F.lit(subtree(tag)))
        odd = odd | (opens != closes) | (opens != whole)
    out = F.regexp_replace(html, COMMENT, " ")
    for tag in dropped:
        out = F.regexp_replace(out, subtree(tag), " ")
    out = F.regexp_replace(out, DECLARATION, " ")
    out = F.regexp_replace(out, TAG, " ")
    out = decode_entities(out)
    out = F.btrim(F.regexp_replace(F.replace(out, F.lit("\u00a0"), F.lit(" ")), r"\s+", " "))
    odd = F.coalesce(odd, F.lit(False))
    by_parser = _parser_udf(dropped)(F.when(odd, html))
    return F.coalesce(F.when(odd, by_parser).otherwise(out), F.lit(""))
