"""Mask-tag grammar: render, wrap, parse, validate and infill, all as column expressions.

``<|MASKED id="m_N" desc="D"|>content<|/MASKED|>`` with both attributes optional; queries
and responses are wrapped in ``<|M_INPUT|>`` / ``<|M_OUTPUT|>``.  Delimiters are
parameters of ``TagGrammar``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillweave.functions.binding import let, let_sql

TAG_TYPE = "array<struct<id:string,desc:string,content:string>>"


#: one tag for each query tag of ``b.q``: response tags are sorted by number, each number's first is kept, and a
#: question for each query tag stands behind them; a tag without a number answers at its place
_NUMBER = "if(string(try_cast(t.id as int)) = t.id, try_cast(t.id as int), null)"
_GIVEN = f"filter(transform(b.r, (t, i) -> struct({_NUMBER} as id, 0 as kind, i as at, t.content as content)), x -> x.id >= 0 and x.id < size(b.q))"
_ASKED = "transform(b.q, (t, i) -> struct(i as id, 1 as kind, i as at, cast(null as string) as content))"
_FIRSTS = "filter(s, (x, j) -> x.kind = 1 or j = 0 or get(s, j - 1).id <> x.id)"
_ANSWERS = (
    "transform(filter(transform(f, (x, j) -> struct(x as x, get(f, j - 1) as before)), p -> p.x.kind = 1), "
    "p -> struct(coalesce(p.before.id = p.x.id and p.before.kind = 0, false) as known, p.before.content as content))"
)
_FILL = (
    "transform(b.q, (t, i) -> struct(string(i) as id, t.desc as desc, coalesce(if(get(a, i).known, get(a, i).content, null), "
    "if(get(b.r, i).id is null, get(b.r, i).content, null)) as content))"
)
_FILLED = (
    f"b -> transform(array(array_sort(concat({_GIVEN}, {_ASKED}))), s -> transform(array({_FIRSTS}), "
    f"f -> transform(array({_ANSWERS}), a -> {_FILL})[0])[0])[0]"
)

ESCAPES = (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"))


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape_attr(value):
    """Escaped text of a plain string or a column."""
    for old, new in ESCAPES:
        value = _replace(value, old, new) if isinstance(value, Column) else value.replace(old, new)
    return value


def joined(*parts) -> Column:
    """Concatenation of columns and plain strings; neighbouring strings become one literal."""
    out: list = []
    for part in parts:
        if isinstance(part, Column) or not out or isinstance(out[-1], Column):
            out.append(part)
        else:
            out[-1] += part
    columns = [p if isinstance(p, Column) else F.lit(p) for p in out]
    return columns[0] if len(columns) == 1 else F.concat(*columns)


def unescape_attr(c: Column) -> Column:
    for old, new in reversed(ESCAPES):
        c = _replace(c, new, old)
    return c


@dataclass(frozen=True)
class TagGrammar:
    tag: str = "MASKED"
    id_prefix: str = "m_"
    query_wrap: str = "M_INPUT"
    response_wrap: str = "M_OUTPUT"

    # ---- literals and patterns -------------------------------------------------
    @property
    def close(self) -> str:
        return f"<|/{self.tag}|>"

    @property
    def head_pattern(self) -> str:
        name, prefix = re.escape(self.tag), re.escape(self.id_prefix)
        return rf'<\|{name}(?: id="{prefix}(\d+)")?(?: desc="([^"]*)")?\|>'

    @property
    def pattern(self) -> str:
        return rf"(?s){self.head_pattern}(.*?)<\|/{re.escape(self.tag)}\|>"

    @property
    def delimiter_pattern(self) -> str:
        names = "|".join(re.escape(n) for n in (self.tag, self.query_wrap, self.response_wrap))
        return rf"<\|/?(?:{names})"

    @property
    def token_pattern(self) -> str:
        """A delimiter with whatever belongs to it: attributes and closing bracket."""
        prefix = re.escape(self.id_prefix)
        return rf'{self.delimiter_pattern}(?: id="{prefix}\d+")?(?: desc="[^"]*")?(?:\|>)?'

    # ---- render ----------------------------------------------------------------
    def render(self, id=None, desc=None, content=None) -> Column:
        """One tag.  A null ``content`` column makes the whole tag null."""
        def text(value):
            return value if isinstance(value, (Column, str)) else str(value)

        parts: list = [f"<|{self.tag}"]
        if id is not None:
            number = id.cast("string") if isinstance(id, Column) else str(id)
            parts += [f' id="{self.id_prefix}', number, '"']
        if desc is not None:
            parts += [' desc="', escape_attr(text(desc)), '"']
        parts.append("|>")
        if content is not None:
            parts.append(text(content))
        return joined(*parts, self.close)

    def _wrap(self, body: Column, name: str) -> Column:
        return joined(f"<|{name}|>", body, f"<|/{name}|>")

    def wrap_query(self, body: Column) -> Column:
        return self._wrap(body, self.query_wrap)

    def wrap_response(self, body: Column) -> Column:
        return self._wrap(body, self.response_wrap)

    # ---- parse -----------------------------------------------------------------
    def _is_wrapped(self, c: Column, name: str) -> Column:
        first, last = f"<|{name}|>", f"<|/{name}|>"
        return (
            c.startswith(F.lit(first))
            & c.endswith(F.lit(last))
            & (F.octet_length(c) >= len(f"{first}{last}".encode()))
        )

    def _seams(self, c: Column) -> Column:
        """How often a tag's end meets the next tag's head.  Lengths in bytes, which a text knows; characters are counted."""
        seam = f"{self.close}<|{self.tag}"
        left = F.octet_length(F.replace(c, F.lit(seam), F.lit("")))
        return (F.octet_length(c) - left) / len(seam.encode())

    def _body(self, c: Column, name: str) -> Column:
        first, last = f"<|{name}|>", f"<|/{name}|>"
        size = F.greatest(F.char_length(c) - (len(first) + len(last)), F.lit(0))
        return F.substring(c, F.lit(len(first) + 1), size)

    def tags(self, c: Column) -> Column:
        """Array of ``(id, desc, content)`` in text order; absent attributes are null.

        The long text is matched once; attributes come from the short tag heads.
        """

        def one(t: Column) -> Column:
            def parts(head: Column) -> Column:
                number = F.regexp_extract(head, self.head_pattern, 1)
                desc = F.regexp_extract(head, self.head_pattern, 2)
                size = F.char_length(t) - F.char_length(head) - len(self.close)
                return F.struct(
                    F.nullif(number, F.lit("")).alias("id"),
                    unescape_attr(F.when(head.contains(' desc="'), desc)).alias("desc"),
                    F.substring(t, F.char_length(head) + 1, size).alias("content"),
                )

            return let(F.regexp_extract(t, self.head_pattern, 0), parts)

        found = F.regexp_extract_all(c, F.lit(self.pattern), F.lit(0))
        return F.transform(found, one).cast(TAG_TYPE)

    # ---- validate and infill ---------------------------------------------------
    def is_valid_pair(self, query: Column, response: Column) -> Column:
        """Never null.  Both texts wrapped; the response is nothing but tags numbered
        ``0..k-1``; the query has ``k`` tags, and those with an id carry their own
        ordinal; no delimiter inside any content or in the query's free text.

        One linear scan of each text lists its delimiters, complete or not; a valid text has
        exactly wrapper, (tag head, tag end) ..., wrapper, so nothing stray can be left.
        """
        opening = f"<|{self.tag}"
        first, last = f"<|{self.response_wrap}|>", f"<|/{self.response_wrap}|>"

        def listed(c: Column) -> Column:
            return F.regexp_extract_all(c, F.lit(self.token_pattern), F.lit(0))

        def head(t: Column, ordinal: Column, numbered: bool) -> Column:
            own = t.startswith(joined(f'{opening} id="{self.id_prefix}', ordinal.cast("string"), '"'))
            if not numbered:
                own = own | ~t.startswith(F.lit(f"{opening} id="))
            # a head that is cut short, or a wrapper, does not pass these
            whole = t.startswith(F.lit(opening)) & t.endswith(F.lit("|>"))
            return whole & own

        def in_order(tokens: Column, wrap: str, numbered: bool) -> Column:
            top = F.size(tokens) - 1

            def right(t: Column, i: Column) -> Column:
                return (
                    F.when(i == 0, t == f"<|{wrap}|>")
                    .when(i == top, t == f"<|/{wrap}|>")
                    .when(i % 2 == 0, t == self.close)
                    .otherwise(head(t, F.floor(i / 2), numbered))
                )

            return F.forall(F.transform(tokens, right), lambda x: x)

        def only_tags(k: Column) -> Column:
            return F.when(k == 0, response == F.lit(first + last)).otherwise(
                response.startswith(F.lit(first + opening))
                & response.endswith(F.lit(self.close + last))
                & (self._seams(response) == k - 1)
            )

        def agree(both: Column) -> Column:
            q, r = both["q"], both["r"]
            return (
                (F.size(q) == F.size(r))
                & (F.size(r) % 2 == 0)
                & in_order(r, self.response_wrap, True)
                & in_order(q, self.query_wrap, False)
                & only_tags(F.floor(F.size(r) / 2) - 1)
            )

        both = F.struct(listed(query).alias("q"), listed(response).alias("r"))
        ok = (
            self._is_wrapped(query, self.query_wrap)
            & self._is_wrapped(response, self.response_wrap)
            & let(both, agree)
        )
        return F.coalesce(ok, F.lit(False))

    def trouble(self, query: Column, response: Column) -> Column:
        """Why a pair is refused: struct ``reason`` and ``at`` (0-based character of the text concerned), null for a valid pair.

        One fold over each text's delimiters, in order; the first rule that fails is named, the query's
        before the response's.  Agrees with ``is_valid_pair``.
        """

        def one(text: Column, wrap: str, name: str, numbered: bool) -> Column:
            """Struct: the text's own trouble, and its number of tags."""
            first, last, head = f"<|{wrap}|>", f"<|/{wrap}|>", f"<|{self.tag}"
            own = f"""concat('{head} id="{self.id_prefix}', string(i div 2), '"')"""
            anonymous = "false" if numbered else f"not startswith(t, '{head} id=')"
            kind = (
                f"case when i = 0 then if(t = '{first}', 0, 1) when i = size(v.tokens) - 1 then if(t = '{last}', 0, 1) "
                f"when i % 2 = 0 then if(t = '{self.close}', 0, 1) when not startswith(t, '{head}') or not endswith(t, '|>') then 1 "
                f"when startswith(t, {own}) or {anonymous} then 0 else 2 end"
            )
            # text before each delimiter, and what is wrong with each: 1 out of place, 2 a wrong number, 3 text before a tag
            between = "3" if numbered else "0"
            wrong = f"transform(v.tokens, (t, i) -> transform(array({kind}), k -> if(k = 0 and i % 2 = 1 and get(v.parts, i) <> '', {between}, k))[0])"
            tail = f"if(get(v.parts, size(v.tokens) - 1) <> '' and size(v.tokens) > 2, {between}, 0)"
            place = "bigint(aggregate(slice(v.parts, 1, p + 1), 0, (n, x) -> n + length(x)) + aggregate(slice(v.tokens, 1, p), 0, (n, x) -> n + length(x)))"
            named = f"struct(concat('{name}: ', element_at(array('delimiter out of place', 'tag number out of order', 'text between tags'), get(f, p))) as reason, {place} as at)"
            first_wrong = f"transform(array(array_position(transform(f, k -> k > 0), true) - 1), p -> if(p < 0, null, {named}))[0]"
            missing = f"when v.text is null then struct('{name}: missing' as reason, cast(null as bigint) as at)"
            bare = f"when not (startswith(v.text, '{first}') and endswith(v.text, '{last}') and length(v.text) >= {len(first) + len(last)}) then struct('{name}: not wrapped' as reason, 0L as at)"
            odd = f"when size(v.tokens) % 2 = 1 and get(f, size(v.tokens) - 1) = 0 and not exists(f, k -> k > 0) then struct('{name}: delimiter out of place' as reason, bigint(length(v.text)) as at)"
            fixed = f"transform({wrong}, (k, i) -> if(i = size(v.tokens) - 1 and k = 0, {tail}, k))"
            body = f"v -> transform(array({fixed}), f -> struct(case {missing} {bare} {odd} else {first_wrong} end as own, size(v.tokens) div 2 - 1 as tags))[0]"
            tokens = F.regexp_extract_all(text, F.lit(self.token_pattern), F.lit(0))
            return let_sql(F.struct(text.alias("text"), tokens.alias("tokens"), F.split(text, self.token_pattern, -1).alias("parts")), body)

        sides = F.struct(one(query, self.query_wrap, "query", False).alias("q"), one(response, self.response_wrap, "response", True).alias("r"))
        counts = "struct('response: another number of tags' as reason, cast(null as bigint) as at)"
        return let_sql(sides, f"s -> coalesce(s.q.own, s.r.own, if(s.q.tags <> s.r.tags, {counts}, null))")

    def can_infill(self, query: Column, response: Column) -> Column:
        """Whether a lenient infill gives a result: the query is a wrapped text."""
        ok = self._is_wrapped(query, self.query_wrap) & response.isNotNull()
        return F.coalesce(ok, F.lit(False))

    def infill_lenient(self, query: Column, response: Column) -> Column:
        """One tag per query tag; content from the first response tag with its number,
        else from the tag at its place if that has no id, else null."""
        return F.when(self.can_infill(query, response), self._fill(query, response))

    def infill_strict(self, query: Column, response: Column) -> Column:
        """As lenient, but null unless the pair is valid."""
        return F.when(self.is_valid_pair(query, response), self._fill(query, response))

    def _fill(self, query: Column, response: Column) -> Column:
        return self.filled(self.tags(query), self.tags(response))

    def filled(self, query_tags: Column, response_tags: Column) -> Column:
        """The lenient infill of parsed tags."""
        return let_sql(F.struct(query_tags.alias("q"), response_tags.alias("r")), _FILLED)

    def is_valid_parsed(self, query: Column, response: Column, query_tags: Column, response_tags: Column) -> Column:
        """``is_valid_pair`` where both texts' tags are known: their numbers, and that no delimiter is left over."""
        k = F.size(response_tags)
        numbered = F.forall(F.transform(response_tags, lambda t, i: t["id"] == i.cast("string")), lambda x: x)
        agrees = F.forall(F.transform(query_tags, lambda t, i: t["id"].isNull() | (t["id"] == i.cast("string"))), lambda x: x)
        tokens = F.lit(self.token_pattern)
        opening, first, last = f"<|{self.tag}", f"<|{self.response_wrap}|>", f"<|/{self.response_wrap}|>"
        only_tags = F.when(k == 0, response == first + last).otherwise(
            response.startswith(first + opening) & response.endswith(self.close + last) & (self._seams(response) == k - 1)
        )
        ok = (
            self._is_wrapped(query, self.query_wrap) & self._is_wrapped(response, self.response_wrap)
            & (F.size(query_tags) == k) & numbered & agrees & only_tags
            & (F.regexp_count(response, tokens) == 2 * k + 2) & (F.regexp_count(query, tokens) == 2 * k + 2)
        )
        return F.coalesce(ok, F.lit(False))

    def restore(self, query: Column, response: Column) -> Column:
        """Text with every mask of the query filled in; null unless the pair is valid."""
        body = self._body(query, self.query_wrap)
        pieces = F.split(body, self.pattern, -1)
        contents = F.transform(self.tags(response), lambda t: t["content"])
        text = F.array_join(
            F.zip_with(pieces, contents, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), ""
        )
        return F.when(self.is_valid_pair(query, response), text)


DEFAULT = TagGrammar()
