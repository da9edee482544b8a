"""HTML facts from page text, one child table per element kind.

Tags are found by pattern in the page text, not by building a tree. Answers that depend on
nesting use tag positions (the form opened last and not yet closed) or the stack of open
elements (:mod:`.markup`). A tag's attributes are read in one linear pass into (names, values),
with character references decoded. Every operator that takes pages reads a table of tags
(:func:`page_tags`) just as well, so that several can share one written table.
"""
from __future__ import annotations

import functools
import html.entities
import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import url as U
from ..functions.logic import any3, first_true, joined, not3
from ..refdata import FIELD_AUTOCOMPLETE, FIELD_TOKENS, FIELD_TYPES, SuffixIndex
from . import markup as M
from .domains import etld1, url_relations

_REST = M.REST
_BLANKED = r"(?is)" + M.RAW
_ATTRIBUTE = r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+"""
_REFERENCE = r"&(?:#[0-9]{1,8}+|#[xX][0-9a-fA-F]{1,7}+|[a-zA-Z][a-zA-Z0-9]{1,31}+);|[^&]++|&"


@functools.lru_cache(maxsize=1)
def _reference_names() -> str:
    """Named references, and the numbers that HTML reads as Windows-1252, as one JSON literal."""
    names = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    old = {f"#{n}": bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    return json.dumps(names | {k: v for k, v in old.items() if v})


def decode_references(text: Column) -> Column:
    """Character references replaced in one pass; unknown ones stay, impossible numbers become U+FFFD."""
    names = F.from_json(F.lit(_reference_names()), "map<string,string>")

    def one(piece):
        inner = F.regexp_extract(piece, r"^&([^&;]+);$", 1)
        digits, hexed = F.regexp_extract(inner, r"^#([0-9]+)$", 1), F.regexp_extract(inner, r"^#[xX]([0-9a-fA-F]+)$", 1)
        number = F.when(digits != "", digits.cast("bigint")).when(hexed != "", F.conv(hexed, 16, 10).cast("bigint"))
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        letter = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        return F.when(inner == "", piece).otherwise(F.coalesce(names[inner], F.when(number.isNotNull(), letter), piece))

    pieces = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def markup(html: str = "html") -> Column:
    """Page text with comments, scripts and styles taken out."""
    return F.regexp_replace(F.col(html), _BLANKED, " ")


def tag(names: str) -> str:
    return rf"(?is)<(?:{names})\b" + _REST


def attributes(tag_text: Column) -> Column:
    """Struct of (names, values) of an opening tag; a value is empty where none is given."""
    body = F.regexp_replace(tag_text, r"^<[^\s/>]++", "")
    part = lambda i: F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(i))
    both = lambda a, b: F.concat(a, b)
    values = F.zip_with(F.zip_with(part(2), part(3), both), part(4), both)
    return F.struct(F.transform(part(1), lambda x: F.lower(x)).alias("names"), F.transform(values, lambda x: decode_references(x)).alias("values"))


def attr(attrs: Column, name: str) -> Column:
    """Value of the first attribute of that name, from :func:`attributes`; NULL when absent, empty text when without a value."""
    return F.get(attrs["values"], F.array_position(attrs["names"], name).cast("int") - 1)


def has(attrs: Column, name: str) -> Column:
    return F.array_contains(attrs["names"], name)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(decode_references(text), r"[\s\u00a0]+", " "))


def plain_text(text: Column) -> Column:
    return squeezed(F.regexp_replace(text, rf"(?is){M.TAG}|<[!?/][^>]*+>", " "))


def prepared(pages: DataFrame) -> DataFrame:
    """Pages with blanked markup and the base that references resolve against: one projection, no join."""
    if "effective_base" in pages.columns:
        return pages
    p = U.settle(pages.withColumn("markup", markup()), "markup")
    first = F.regexp_extract("markup", r"(?is)(<base\b(?=[^>]*\shref)[^>]*>)", 1)
    p = p.withColumn("raw_href", F.when(first != "", attr(attributes(first), "href")))
    p = U.with_resolved(p.withColumn("_r0", F.nullif(F.trim("raw_href"), F.lit(""))), "_r0", "url", "base_url").drop("_r0")
    return p.withColumn("effective_base", F.coalesce("base_url", "url"))


def page_tags(pages: DataFrame) -> DataFrame:
    """All tags of the pages with their base, to be written once; see :func:`.markup.page_tags`."""
    return M.page_tags(prepared(pages))


def _of_tags(tags: DataFrame, *names: str) -> DataFrame:
    return with_attributes(tags.where(F.col("tag").isin(*names)))


def elements(pages: DataFrame, names: str) -> DataFrame:
    """One row per opening tag, in page order, with its attributes and its page's base."""
    if "tag_text" in pages.columns:
        return _of_tags(pages, *names.split("|"))
    found = F.regexp_extract_all("markup", F.lit(tag(names)), F.lit(0))
    return with_attributes(prepared(pages).select("page_id", "url", "effective_base", F.posexplode(found).alias("pos", "tag_text")))


def with_attributes(tags: DataFrame) -> DataFrame:
    return U.settle(tags.withColumn("attrs", attributes(F.col("tag_text"))), "attrs")


def stable_element_ids(els: DataFrame, kind: str, html_id: str = "html_id", out: str = "element_id") -> DataFrame:
    """The element's own id if unique on its page, else ``<kind>-<n>``, prefixed until it is free.

    Ids on the page that such a name could meet are ``generated:`` repeated before ``<kind>-<n>``; the lowest number of
    repeats that none of them has is free.
    """
    hid = F.nullif(F.trim(F.coalesce(html_id, F.lit(""))), F.lit(""))
    e = els.withColumn("_hid", hid)
    e = e.withColumn("_dup", F.count("_hid").over(Window.partitionBy("page_id", "_hid")))
    e = e.withColumn("_made", F.concat(F.lit(f"{kind}-"), F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("string")))
    form = rf"^((?:generated:)*+)({kind}-[0-9]+)$"
    taken = e.where(F.col("_hid").rlike(form)).select(F.col("page_id").alias("_p"), F.regexp_extract("_hid", form, 2).alias("_t"), (F.length(F.regexp_extract("_hid", form, 1)) / 10).cast("int").alias("_r"))
    taken = taken.groupBy("_p", "_t").agg(F.array_sort(F.collect_set("_r")).alias("_rs"))
    e = e.join(taken, (F.col("page_id") == F.col("_p")) & (F.col("_made") == F.col("_t")), "left")
    # In the sorted repeats 0, 1, 2, ... the first gap is free.
    gap = F.aggregate("_rs", F.lit(0), lambda free, r: F.when(r == free, free + 1).otherwise(free))
    made = F.concat(F.repeat(F.lit("generated:"), F.coalesce(gap, F.lit(0))), "_made")
    own = F.col("_hid").isNotNull() & (F.col("_dup") == 1)
    return e.withColumn(out, F.when(own, F.col("_hid")).otherwise(made)).drop("_hid", "_dup", "_made", "_p", "_t", "_rs")


# ---- documents -----------------------------------------------------------------------------

def html_cap(pages: DataFrame, max_bytes: int) -> DataFrame:
    """HTML over the limit is cut and marked incomplete, with an error code."""
    over = F.octet_length("html") > max_bytes
    cut = F.make_valid_utf8(F.substring(F.encode("html", "UTF-8"), 1, max_bytes).cast("string"))
    return pages.select("page_id", F.when(over, cut).otherwise(F.col("html")).alias("html"), (~over).alias("source_complete"),
                        F.when(over, "html_source_truncated").alias("error"))


def html_type_filter(pages: DataFrame) -> DataFrame:
    """Pages that are not HTML get an error and are not analysed; a missing type is analysed unless collection failed."""
    m = F.nullif(F.lower(F.trim(F.split_part("content_type", F.lit(";"), F.lit(1)))), F.lit(""))
    error = first_true([(m.isNull() & F.col("error_code").isNotNull(), "content_type_missing"),
                        (m.isNotNull() & ~m.isin("text/html", "application/xhtml+xml"), "unsupported_content_type")])
    return pages.select("page_id", error.isNull().alias("analysed"), error.alias("error"))


def page_document(pages: DataFrame, index: SuffixIndex) -> DataFrame:
    d = pages.select("page_id", "url", "source_complete", F.octet_length("html").alias("size"), F.sha2("html", 256).alias("sha256"),
                     plain_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title\s*>", 1)).alias("title"))
    return etld1(d, index, "url", "etld1").drop("url")


def _hides(name: Column, tag_text: Column) -> Column:
    """Whether an element shows nothing: by its name, the hidden attribute or its inline style."""
    asks = tag_text.rlike(r"(?i)[\s\"'/](?:hidden|style)\b")
    attrs = attributes(tag_text)
    style = F.coalesce(attr(attrs, "style"), F.lit("")).rlike(M.HIDDEN_STYLE)
    return name.isin(*M.UNSHOWN) | F.when(asks, has(attrs, "hidden") | style).otherwise(False)


def page_visible_text(pages: DataFrame) -> DataFrame:
    """Text outside head, scripts, templates, comments and elements hidden by attribute or inline style, to their own end tags."""
    return M.shown_text(pages.select("page_id", "html"), _hides).select("page_id", squeezed(F.col("text")).alias("text"))


def page_base(pages: DataFrame) -> DataFrame:
    """First base href and the base that references resolve against."""
    p = prepared(pages)
    return p.select("page_id", "url", "raw_href", "base_url", "effective_base", F.when(F.col("raw_href").isNotNull(), F.col("base_url").isNotNull()).alias("valid"))


def base_url_change(pages: DataFrame, bases: DataFrame, index: SuffixIndex) -> DataFrame:
    """A base in another registered domain; without a base there is none, which a cut page does not show."""
    d = etld1(etld1(bases, index, "url", "own"), index, "base_url", "base")
    ext = F.when(F.col("raw_href").isNull(), F.lit(False)).when(F.col("valid"), F.col("base") != F.col("own"))
    d = d.select("page_id", ext.alias("changed"), "base_url")
    j = page_sources(pages).join(d, "page_id", "left")
    return j.select("page_id", html_result(F.col("changed")).alias("r"), "base_url").select("page_id", "r.*", "base_url")


def meta_refresh(pages: DataFrame) -> DataFrame:
    """First meta refresh with its delay and target; invalid ones keep their text."""
    e = elements(pages, "meta").withColumn("eq", F.lower(F.trim(attr(F.col("attrs"), "http-equiv")))).where("eq = 'refresh'")
    one = e.groupBy("page_id", "effective_base").agg(F.min_by("attrs", "pos").alias("attrs"))
    m = one.withColumn("raw_content", F.coalesce(attr(F.col("attrs"), "content"), F.lit("")))
    pat = r"(?is)^\s*(\d+(?:\.\d*)?|\.\d+)\s*(?:;\s*(?:url\s*=\s*)?(.+?)\s*)?$"
    raw = F.trim(F.regexp_replace(F.trim(F.regexp_extract("raw_content", pat, 2)), "^[\"']+|[\"']+$", ""))
    m = U.with_resolved(m.withColumn("_t", F.nullif(raw, F.lit(""))), "_t", "effective_base", "target_url")
    ok = F.col("raw_content").rlike(pat) & (F.col("_t").isNull() | F.col("target_url").isNotNull())
    return m.select("page_id", "raw_content", ok.alias("valid"), F.when(ok, F.regexp_extract("raw_content", pat, 1).try_cast("double")).alias("delay_seconds"), F.when(ok, F.col("target_url")).alias("target_url"))


def page_sources(pages: DataFrame) -> DataFrame:
    """What a page result needs to know: whether there is a source, and whether it is complete (unless said otherwise)."""
    whole = F.coalesce("source_complete", F.lit(True)) if "source_complete" in pages.columns else F.lit(True)
    return pages.select("page_id", F.col("html").isNotNull().alias("parsed"), whole.alias("source_complete"))


def html_result(detected: Column, applies: Column | None = None) -> Column:
    """(status, detected, error) of a page check over :func:`page_sources`; the one place where these states are worked out.

    Without a source nothing is known; what there is nothing of to check does not apply; a cut source proves presence, not
    absence; else the check is evaluated, and its result may still be unknown.
    """
    rules = [(~F.col("parsed"), "html_not_parsed"), (~F.col("source_complete") & (detected == F.lit(False)), "html_analysis_incomplete")]
    idle = F.lit(False) if applies is None else F.col("parsed") & ~applies
    error = F.when(~idle, first_true(rules))
    status = F.when(idle, "not_applicable").when(error.isNotNull(), "error").otherwise("evaluated")
    return F.struct(status.alias("status"), F.when(status == "evaluated", detected).alias("detected"), error.alias("error"))


def found_or_unknown(found: Column) -> Column:
    """What was not found on a page that was cut is unknown."""
    return F.when(found, F.lit(True)).when(F.coalesce("source_complete", F.lit(True)), F.lit(False))


def html_redirect(pages: DataFrame, refresh: DataFrame) -> DataFrame:
    j = pages.select("page_id", "source_complete").join(refresh, "page_id", "left")
    return j.select("page_id", found_or_unknown(F.coalesce("valid", F.lit(False))).alias("detected"), "target_url", "delay_seconds")


# ---- forms ---------------------------------------------------------------------------------

def form_tokens(pages: DataFrame) -> DataFrame:
    """Form, control and form-end tags in page order, each with the form that encloses it."""
    found = F.regexp_extract_all("markup", F.lit(r"(?is)</form\s*>|<(?:form|input|textarea|select|button)\b" + _REST), F.lit(0))
    if "tag_text" in pages.columns:
        t = _of_tags(pages, "/form", "form", "input", "textarea", "select", "button")
    else:
        t = with_attributes(prepared(pages).select("page_id", "url", "effective_base", F.posexplode(found).alias("pos", "tag_text")))
        t = t.withColumn("tag", F.lower(F.regexp_extract("tag_text", r"^<(/?[a-zA-Z]+)", 1)))
    w = Window.partitionBy("page_id").orderBy("pos")
    t = t.withColumn("form_no", F.when(F.col("tag") == "form", F.count_if(F.col("tag") == "form").over(w)))
    mark = F.when(F.col("tag").isin("form", "/form"), F.coalesce(F.col("form_no"), F.lit(0)))
    return t.withColumn("enclosing", F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit(0)))


def page_forms(tokens: DataFrame) -> DataFrame:
    """Forms with method, resolved action and how it was resolved, from ``form_tokens``."""
    f = tokens.where("tag = 'form'")
    f = f.withColumns({"html_id": attr(F.col("attrs"), "id"), "action_raw": attr(F.col("attrs"), "action"),
                       "method": F.coalesce(F.nullif(F.lower(F.trim(attr(F.col("attrs"), "method"))), F.lit("")), F.lit("get"))})
    f = stable_element_ids(f, "form", out="form_id")
    blank = F.coalesce(F.trim("action_raw"), F.lit("")) == ""
    f = U.with_resolved(f.withColumn("_r", F.when(~blank, F.col("action_raw"))), "_r", "effective_base", "_a")
    url = F.when(blank, F.when(U.is_http(F.col("url")), F.col("url"))).otherwise(F.col("_a"))
    res = first_true([(F.col("action_raw").isNull(), "implicit_document"), (blank, "empty_document"), (F.col("_a").isNotNull(), "resolved")], "invalid_or_non_http")
    return f.select("page_id", "url", "form_id", "form_no", F.nullif(F.trim("html_id"), F.lit("")).alias("html_id"), "method", url.alias("action_url"), res.alias("resolution"))


def form_controls(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """Control to form by explicit id, else by the enclosing form; an id that two forms share attaches to neither."""
    c = tokens.where("tag IN ('input', 'textarea', 'select', 'button')").withColumn("ref", F.nullif(F.trim(F.coalesce(attr(F.col("attrs"), "form"), F.lit(""))), F.lit("")))
    ids = forms.where("html_id IS NOT NULL").groupBy("page_id", F.col("html_id").alias("ref")).agg(F.count("*").alias("n"), F.min("form_id").alias("by_id"))
    near = forms.select("page_id", F.col("form_no").alias("enclosing"), F.col("form_id").alias("by_place"))
    j = c.join(ids, ["page_id", "ref"], "left").join(near, ["page_id", "enclosing"], "left")
    form = F.when(F.col("ref").isNotNull(), F.when(F.col("n") == 1, F.col("by_id"))).otherwise(F.col("by_place"))
    kind = first_true([(F.col("ref").isNotNull() & (F.col("n") == 1), "explicit"), (F.col("ref").isNotNull() & (F.col("n") > 1), "ambiguous"),
                       (F.col("ref").isNotNull(), "unresolved"), (F.col("by_place").isNotNull(), "enclosing")], "none")
    return j.select("page_id", "url", "effective_base", "pos", "tag", "attrs", form.alias("form_id"), kind.alias("association"))


def page_inputs(controls: DataFrame) -> DataFrame:
    i = controls.where("tag IN ('input', 'textarea', 'select')")
    t = F.col("attrs")
    i = i.withColumns({"html_id": attr(t, "id"), "type": F.coalesce(F.nullif(F.lower(F.trim(attr(t, "type"))), F.lit("")), F.lit("text")),
                       "name": attr(t, "name"), "placeholder": attr(t, "placeholder"), "autocomplete": attr(t, "autocomplete"),
                       "disabled": has(t, "disabled"), "readonly": has(t, "readonly")})
    i = stable_element_ids(i, "input", out="field_id")
    return i.select("page_id", "field_id", "form_id", "tag", "type", "name", "html_id", "placeholder", "autocomplete", "disabled", "readonly", (F.col("type") == "hidden").alias("hidden"))


def page_buttons(controls: DataFrame, forms: DataFrame) -> DataFrame:
    t = F.col("attrs")
    b = controls.withColumn("type", F.lower(F.coalesce(F.nullif(attr(t, "type"), F.lit("")), F.when(F.col("tag") == "button", "submit"))))
    b = b.where("tag = 'button' OR (tag = 'input' AND type IN ('submit', 'image', 'button', 'reset'))")
    b = b.withColumns({"html_id": attr(t, "id"), "formaction": attr(t, "formaction"), "formmethod": F.nullif(attr(t, "formmethod"), F.lit("")), "disabled": has(t, "disabled")})
    b = stable_element_ids(b, "button", out="button_id")
    b = U.with_resolved(b.withColumn("_r", F.nullif("formaction", F.lit(""))), "_r", "effective_base", "_a")
    j = b.join(forms.select("page_id", "form_id", "method", "action_url"), ["page_id", "form_id"], "left")
    action = F.when(F.col("formaction") == "", F.col("url")).when(F.col("formaction").isNotNull(), F.col("_a")).otherwise(F.col("action_url"))
    return j.select("page_id", "url", "button_id", "form_id", "type", "disabled", action.alias("effective_action"), F.lower(F.coalesce("formmethod", "method", F.lit("get"))).alias("effective_method"))


def credential_classify(inputs: DataFrame) -> DataFrame:
    """Field type, then autocomplete word, then name tokens; several kinds leave it unknown."""
    table = lambda t: F.create_map(*[x for k, v in t.items() for x in (F.lit(k), F.lit(v))])
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"[\W_]+", "")
    tokens = table({tok.replace("-", "").replace("_", ""): kind for kind, toks in FIELD_TOKENS.items() for tok in toks})
    terms = F.concat(*[F.concat(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[\W_]+"), F.array(squeeze(F.coalesce(c, F.lit(""))))) for c in ("html_id", "name", "placeholder")])
    kinds = F.array_distinct(F.filter(F.transform(terms, lambda x: tokens[x]), lambda k: k.isNotNull()))
    auto = F.filter(F.transform(F.split(F.lower(F.trim(F.coalesce("autocomplete", F.lit("")))), r"\s+"), lambda x: table(FIELD_AUTOCOMPLETE)[x]), lambda k: k.isNotNull())
    kind = F.coalesce(table(FIELD_TYPES)[F.col("type")], F.get(auto, F.lit(0)), F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))))
    return inputs.withColumn("credential_type", kind)


def credential_form(pages: DataFrame, fields: DataFrame) -> DataFrame:
    f = fields.where("credential_type IS NOT NULL AND form_id IS NOT NULL").select("page_id", "form_id").distinct()
    g = f.groupBy("page_id").agg(F.count("*").alias("form_count"), joined(F.collect_set("form_id")).alias("form_ids"))
    return pages.select("page_id", "source_complete").join(g, "page_id", "left").select("page_id", found_or_unknown(F.col("form_count").isNotNull()).alias("detected"), F.coalesce("form_count", F.lit(0)).alias("form_count"), "form_ids")


def credential_field(pages: DataFrame, fields: DataFrame) -> DataFrame:
    g = fields.where("credential_type IS NOT NULL").groupBy("page_id").agg(joined(F.collect_set("credential_type")).alias("field_types"))
    return pages.select("page_id", "source_complete").join(g, "page_id", "left").select("page_id", found_or_unknown(F.col("field_types").isNotNull()).alias("detected"), "field_types")


def native_submission(inputs: DataFrame) -> DataFrame:
    """Whether a control can contribute to native form data, from its captured attributes."""
    kind = F.when(F.col("tag") == "input", F.col("type")).otherwise("")
    state = first_true([
        (F.col("disabled"), "excluded_disabled"), (kind.isin("button", "reset"), "excluded_non_submit_control"),
        (kind == "image", "coordinates_only_if_activated_submitter"), (F.coalesce("name", F.lit("")) == "", "excluded_missing_name"),
        (F.col("disabled").isNull(), "unknown_disabled_state_not_recorded"), (kind.isin("checkbox", "radio"), "conditional_checked_state_required"),
        (kind == "submit", "conditional_activated_submitter_required")], "candidate_under_recorded_attributes_only")
    return inputs.select("page_id", "field_id", state.alias("state"))


def form_action_domain(forms: DataFrame, index: SuffixIndex) -> DataFrame:
    d = etld1(etld1(forms, index, "url", "own"), index, "action_url", "dest")
    return d.select("page_id", "form_id", (F.col("dest") == F.col("own")).alias("domain_match"), F.lit(None).cast("boolean").alias("detected"))


def external_post(pages: DataFrame, forms: DataFrame, buttons: DataFrame, rules: DataFrame | SuffixIndex) -> DataFrame:
    """Posts to another site scope; unresolved destinations keep the page undecided, and to one without posts it does not apply."""
    f = forms.where("method = 'post'").select("page_id", "url", F.col("action_url").alias("dest"))
    b = buttons.where("form_id IS NOT NULL AND type IN ('submit', 'image') AND NOT disabled AND effective_method = 'post'")
    b = b.select("page_id", "url", F.col("effective_action").alias("dest"))
    r = url_relations(f.unionByName(b), rules, "url", "dest").withColumn("external", not3(F.col("same_site_scope")))
    g = r.groupBy("page_id").agg(any3(F.col("external")).alias("external"), F.min(F.when(F.col("external"), F.col("dest"))).alias("destination"), F.count("*").alias("posts"))
    j = page_sources(pages).join(g, "page_id", "left")
    return j.select("page_id", html_result(F.col("external"), F.col("posts").isNotNull()).alias("r"), "destination", F.coalesce("posts", F.lit(0)).alias("posts")).select("page_id", "r.*", "destination", "posts")


# ---- resources -----------------------------------------------------------------------------

def page_images(pages: DataFrame, index: SuffixIndex) -> DataFrame:
    i = elements(pages, "img").withColumns({"html_id": attr(F.col("attrs"), "id"), "src_raw": attr(F.col("attrs"), "src")})
    i = U.with_resolved(stable_element_ids(i, "image", out="image_id"), "src_raw", "effective_base", "resource_url")
    return etld1(i, index, "resource_url", "domain").select("page_id", "image_id", "resource_url", "domain")


def page_favicon(pages: DataFrame, index: SuffixIndex) -> DataFrame:
    e = elements(pages, "link").where(F.array_contains(F.split(F.lower(F.trim(attr(F.col("attrs"), "rel"))), r"\s+"), "icon"))
    one = e.groupBy("page_id", "effective_base").agg(F.min_by("attrs", "pos").alias("attrs")).withColumn("href", attr(F.col("attrs"), "href"))
    i = U.with_resolved(one, "href", "effective_base", "resource_url")
    return etld1(i, index, "resource_url", "domain").select("page_id", "resource_url", "domain")


def page_open_graph(pages: DataFrame) -> DataFrame:
    e = elements(pages, "meta").withColumn("property", F.lower(F.trim(attr(F.col("attrs"), "property")))).where("property LIKE 'og:%'")
    last = e.groupBy("page_id", "effective_base", "property").agg(F.max_by("attrs", "pos").alias("attrs")).withColumn("content", attr(F.col("attrs"), "content"))
    url = last.withColumn("_u", F.when(F.col("property").isin("og:image", "og:image:url", "og:url", "og:video", "og:audio"), F.col("content")))
    return U.with_resolved(url, "_u", "effective_base", "resource_url").select("page_id", "property", "content", "resource_url")


# An anchor with what follows up to the next start or end of one, or any other piece, so that reading stays in step.
_ANCHOR = r"(?is)<a(?=[\s>/])" + M.REST + rf"(?:[^<]++|(?!</?a[\s>/])(?:{M.TAG}|<))*+|{M.TAG}|[^<]++|<"
_ANCHOR_TAG = r"(?is)^(<a(?=[\s>/])" + M.REST + ")"


def page_links(pages: DataFrame) -> DataFrame:
    """Anchors with their text, raw and resolved address; one without its end tag ends where the next begins."""
    anchors = F.filter(F.regexp_extract_all("markup", F.lit(_ANCHOR), F.lit(0)), lambda x: x.rlike(r"(?i)^<a[\s/]"))
    pair = F.transform(anchors, lambda x: F.struct(x.alias("x"), F.regexp_extract(x, _ANCHOR_TAG, 1).alias("tag_text")))
    found = F.filter(pair, lambda p: has(attributes(p["tag_text"]), "href"))
    e = prepared(pages).select("page_id", "url", "effective_base", F.posexplode(found).alias("pos", "p")).select("page_id", "url", "effective_base", "pos", "p.*")
    e = with_attributes(e.withColumn("text", plain_text(F.col("x"))).drop("x"))
    e = e.withColumns({n: attr(F.col("attrs"), n) for n in ("href", "download", "target")}).drop("tag_text", "attrs")
    e = U.with_resolved(e, "href", "effective_base", "destination")
    return e.select("page_id", "url", F.concat(F.lit("link-"), (F.col("pos") + 1).cast("string")).alias("link_id"), "pos", "text", "href", "destination", "download", "target")


def page_frames(pages: DataFrame) -> DataFrame:
    f = elements(pages, "iframe").withColumns({"src_raw": attr(F.col("attrs"), "src"), "srcdoc": attr(F.col("attrs"), "srcdoc")})
    f = U.with_resolved(f, "src_raw", "effective_base", "src")
    return f.select("page_id", F.concat(F.lit("frame-"), (F.col("pos") + 1).cast("string")).alias("frame_id"), "src", "srcdoc")


def page_inline_handlers(pages: DataFrame) -> DataFrame:
    """Event attributes, quoted or not, of the tags that have any."""
    found = F.filter(F.regexp_extract_all("markup", F.lit(tag("[a-z][a-z0-9]*")), F.lit(0)), lambda x: x.rlike(r"(?i)[\s\"'/]on[a-z]+\s*="))
    e = with_attributes(prepared(pages).select("page_id", F.explode(found).alias("tag_text")))
    pairs = F.filter(F.arrays_zip(F.col("attrs.names").alias("event"), F.col("attrs.values").alias("source")), lambda p: p["event"].rlike("^on[a-z]+$"))
    x = e.select("page_id", F.lower(F.regexp_extract("tag_text", r"^<([a-zA-Z0-9]+)", 1)).alias("tag"), F.explode(pairs).alias("h"))
    return x.select("page_id", "tag", "h.event", "h.source")


def link_cap(links: DataFrame, flagged: DataFrame, n: int = 40) -> DataFrame:
    """Pages over budget keep their first n links, others keep all; counts say what was left out."""
    f = flagged.select("page_id").distinct().withColumn("flagged", F.lit(True))
    g = links.groupBy("page_id").agg(F.count("*").alias("links")).join(f, "page_id", "left")
    kept = F.when(F.col("flagged"), F.least("links", F.lit(n))).otherwise(F.col("links"))
    return g.select("page_id", kept.alias("kept"), (F.col("links") - kept).alias("omitted_n"))


def host_profile(pages: DataFrame, rules: DataFrame | SuffixIndex) -> DataFrame:
    """Per host: pages, links, links to another site scope and whether its labels are word-split."""
    links = url_relations(page_links(pages).select("page_id", "url", "destination"), rules, "url", "destination")
    per_page = links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(~F.col("same_site_scope")).alias("external"))
    h = U.with_host(pages.select("page_id", "url"), "url", "hostname").join(per_page, "page_id", "left")
    g = h.groupBy("hostname").agg(F.count("*").alias("pages"), F.sum(F.coalesce("links", F.lit(0))).alias("links"), F.sum(F.coalesce("external", F.lit(0))).alias("external_links"))
    return g.withColumn("word_split", F.col("hostname").rlike(r"(^|\.)[^.]*[^.\-_]+[\-_]+[^.\-_]+[^.]*\.[^.]+"))
