"""References resolved against the address of the page that holds them, as column expressions."""

from pyspark.sql import Column, functions as F

from .text import bind

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def parts(address: Column) -> Column:
    """Struct of scheme, authority, path, query and fragment; missing ones are null, the path never."""
    def cut(text):
        scheme = F.nullif(F.regexp_extract(text, _SCHEME, 1), F.lit(""))
        rest = F.regexp_replace(text, _SCHEME, "")
        plain = F.split_part(rest, F.lit("#"), F.lit(1))
        path = F.split_part(plain, F.lit("?"), F.lit(1))
        return F.struct(
            F.lower(scheme).alias("scheme"),
            F.when(path.startswith("//"), F.regexp_extract(path, "^//([^/]*)", 1)).alias("authority"),
            F.regexp_replace(path, "^//[^/]*", "").alias("path"),
            F.when(F.contains(plain, F.lit("?")), F.substr(plain, F.locate("?", plain) + 1)).alias("query"),
            F.when(F.contains(rest, F.lit("#")), F.substr(rest, F.locate("#", rest) + 1)).alias("fragment"),
        )

    return bind(address, cut)


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments carried out; those above the root are dropped."""
    def fold(segments):
        last = F.element_at(segments, -1)
        # the first segment of an absolute path is empty and stays
        kept = F.aggregate(
            segments, F.array().cast("array<string>"),
            lambda done, s: F.when(s == ".", done).when(
                s == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
            ).otherwise(F.array_append(done, s)),
        )
        ended = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
        return F.array_join(ended, "/")

    return bind(F.split(path, "/"), fold)


def resolve(base: Column, reference: Column) -> Column:
    """The absolute address of ``reference`` in a document at ``base``.

    Follows the generic syntax of addresses: a scheme of its own, ``//host``, absolute and relative
    paths with dot segments, a query or a fragment only.  Addresses without a hierarchy (``mailto:``)
    stay as they are.  Without a base only references with a scheme have an address.  Blanks around a reference and line breaks and tabs inside it do not count.
    """
    clean = F.regexp_replace(F.btrim(reference, F.lit(" \t\n\r\x0c")), r"[\t\n\r]", "")

    def joined(p):
        b, r = p["b"], p["r"]
        folder = F.regexp_extract(b["path"], "^(.*/)[^/]*$", 1)
        merged = F.when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(
            F.concat(folder, r["path"])
        )
        rooted = F.when(r["path"].startswith("/"), r["path"]).otherwise(merged)
        own = r["scheme"].isNotNull()
        same_host = ~own & r["authority"].isNull()
        same_path = same_host & (r["path"] == "")
        path = F.when(same_path, b["path"]).when(same_host, without_dots(rooted)).when(
            r["path"].startswith("/"), without_dots(r["path"])
        ).otherwise(r["path"])
        scheme = F.when(own, r["scheme"]).otherwise(b["scheme"])
        authority = F.when(same_host, b["authority"]).otherwise(r["authority"])
        query = F.when(same_path & r["query"].isNull(), b["query"]).otherwise(r["query"])

        def part(before, value):
            return F.coalesce(F.concat(F.lit(before), value), F.lit(""))

        whole = F.concat(
            F.coalesce(F.concat(scheme, F.lit(":")), F.lit("")), part("//", authority), path, part("?", query),
            part("#", r["fragment"]),
        )
        return F.when(own | b["path"].isNotNull(), whole)

    return bind(F.struct(parts(base).alias("b"), parts(clean).alias("r")), joined)
