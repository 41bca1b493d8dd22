"""Cut text into paragraphs, sentences, fixed widths, and chunks of bounded size that overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import CHARS_PER_TOKEN, SENTENCE_ENDS, blank, bound, folded, strip, tokens

MAX_TOKENS = 7000
OVERLAP_TOKENS = 300
_STRINGS = "array<string>"


def paragraphs(text: Column) -> Column:
    """Paragraphs with the blank lines after them; blank lines at the start are dropped."""
    return F.filter(F.split(F.regexp_replace(text, "^\n{2,}", ""), "(?<=\n\n)(?!\n)"), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Sentences with all their end marks; blank ones are dropped."""
    return F.filter(F.split(text, f"(?<=[{SENTENCE_ENDS}])(?![{SENTENCE_ENDS}])"), lambda s: ~blank(s))


def widths(max_tokens: int, overlap: int) -> tuple[int, int]:
    """(width, overlap) in characters; an overlap that leaves no progress becomes a fifth of the width."""
    width, shared = max(1, max_tokens * CHARS_PER_TOKEN), max(0, overlap * CHARS_PER_TOKEN)
    return width, shared if shared < width else width // 5


def hard_split(text: Column, max_tokens: int, overlap: int) -> Column:
    """Windows of full width, each beginning before the end of the last; a blank window is left out and shifts what follows.

    One pass cuts the text into blocks of one step, and every window is a part of neighbouring blocks. Without a blank window their
    places are known; otherwise a fold goes from window to window. Both take time in proportion to the text.
    """
    width, shared = widths(max_tokens, overlap)
    step = width - shared
    whole = -(-width // step)  # blocks that a window needs

    def windows(blocks: Column, chars: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil((chars - width) / F.lit(step)).cast("int") + 1)
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.left(F.array_join(F.slice(blocks, i, F.lit(whole)), ""), F.lit(width)))

    def window(blocks: Column, at: Column) -> Column:
        around = F.array_join(F.slice(blocks, F.floor(at / F.lit(step)).cast("int") + 1, F.lit(whole + 1)), "")
        return F.substr(around, at % step + 1, F.lit(width))

    def walked(blocks: Column, chars: Column) -> Column:
        def next_window(acc: Column, _: Column) -> Column:
            at = acc["at"]

            def place(gap: Column) -> Column:
                following = F.when(at + width >= chars, F.lit(-1)).when(gap, at + width).otherwise(at + step)
                return F.struct(F.when(gap, acc["out"]).otherwise(F.concat(acc["out"], F.array(at))).alias("out"), following.alias("at"))

            return F.when(at < 0, acc).otherwise(bound(blank(window(blocks, at)), place, acc))

        nowhere = F.array().cast("array<int>")
        start = F.struct(nowhere.alias("out"), F.lit(0).alias("at"))
        places = folded(F.sequence(F.lit(0), F.ceil(chars / F.lit(step)).cast("int")), start, nowhere, next_window)
        return F.transform(places, lambda at: window(blocks, at))

    def cut(blocks: Column) -> Column:
        return bound(F.length(text), lambda chars: bound(windows(blocks, chars), lambda w: F.when(F.exists(w, blank), walked(blocks, chars)).otherwise(w), none), none)

    blocks, none = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), F.array().cast(_STRINGS)
    return F.when(blank(text), none).otherwise(bound(blocks, cut, none))


def segments(text: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Paragraphs; those above max_tokens as sentences. Where a blank paragraph follows, the segment before it ends in a blank line."""

    def ended(s: Column) -> Column:
        return F.when(s.endswith("\n\n"), s).otherwise(F.concat(F.rtrim(s, F.lit("\n")), F.lit("\n\n")))

    def cut(all_: Column):
        def of(p: Column, i: Column) -> Column:
            gap = F.coalesce(blank(F.get(all_, i + 1)), F.lit(False))
            parts = lambda s: F.when(gap, F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(ended(F.element_at(s, -1))))).otherwise(s)
            return F.when(blank(p), F.array().cast(_STRINGS)).when(tokens(strip(p)) > max_tokens, bound(sentences(p), parts)).otherwise(F.array(p))

        return of

    return bound(paragraphs(text), lambda all_: F.flatten(F.transform(all_, cut(all_))), F.array().cast(_STRINGS))


def chunks(text: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, clean: bool = False) -> Column:
    """Chunks of about max_tokens that repeat the end of the chunk before; no chunk is blank.

    With clean, chunks that only repeat the end of the chunk before are left out: they cost a call and add nothing.

    A fold over the segments' sizes. A segment above the limit is cut by width. When the next segment doesn't fit, the last
    elements of the chunk (up to 1.1 times the overlap, one at least) are carried over; if what is carried and the segment don't fit together,
    it is a chunk of its own. What is carried becomes one element: text, from the end of a cut segment or empty, and the
    segments from ``start`` up to ``mid``. No text moves until the parts of all chunks are known.
    """
    no_chunks, nothing, zero = F.array().cast(_STRINGS), F.lit(""), F.lit(0)
    tail, carry_most = int(overlap * CHARS_PER_TOKEN * 0.8), F.lit(overlap * 1.1)
    part = lambda text_, start, end: F.struct(text_.alias("text"), start.alias("start"), end.alias("end"))
    no_parts = F.array().cast("array<struct<text:string,start:int,end:int>>")
    head = lambda text_, start, mid, carried: F.struct(text_.alias("text"), start.alias("start"), mid.alias("mid"), carried.alias("carried"))  # noqa: E731  carried: its characters
    state = lambda out, first, next_, tok: F.struct(out.alias("out"), first.alias("head"), next_.alias("next"), tok.alias("tok"))  # noqa: E731  tok: tokens of all elements
    fresh = lambda at: head(nothing, at, at, zero)

    def filled(acc: Column) -> Column:
        return (acc["next"] > acc["head"]["start"]) | (acc["head"]["text"] != "")

    def buffered(acc: Column) -> Column:
        return part(acc["head"]["text"], acc["head"]["start"], acc["next"])

    def packed(found: Column) -> Column:
        def fold(chars: Column) -> Column:
            def oversize(acc: Column) -> Column:
                def after(pieces: Column) -> Column:
                    before = F.when(filled(acc), F.array(buffered(acc))).otherwise(no_parts)
                    out = F.concat(acc["out"], before, F.transform(pieces, lambda p: part(p, zero, zero)))
                    last, at = F.element_at(pieces, -1), acc["next"] + 1
                    bare = state(out, fresh(at), at, zero)
                    if overlap <= 0:
                        return bare
                    kept = lambda c: state(out, head(c, at, at, F.length(c)), at, F.shiftright(F.length(c), 1))
                    return bound(F.right(last, F.lit(tail)), lambda c: F.when((F.length(last) > tail) & ~blank(c), kept(c)).otherwise(bare), acc)

                return bound(hard_split(F.get(found, acc["next"]), max_tokens, overlap), after, acc)

            def overflow(acc: Column, n: Column) -> Column:
                at, out, old = acc["next"], F.concat(acc["out"], F.array(buffered(acc))), acc["head"]
                alone = lambda before: state(before, fresh(at), at + 1, n)
                if overlap <= 0:
                    return alone(out)
                own = at - old["mid"]
                seen_of = lambda k, tok, chars_, done: F.struct(k.alias("k"), tok.alias("tok"), chars_.alias("chars"), done.alias("done"))

                def back(seen: Column, m: Column) -> Column:
                    tok = seen["tok"] + F.shiftright(m, 1)
                    more = ~seen["done"] & ((seen["k"] == 0) | (tok <= carry_most))
                    return F.when(more, seen_of(seen["k"] + 1, tok, seen["chars"] + m, F.lit(False))).otherwise(seen_of(seen["k"], seen["tok"], seen["chars"], F.lit(True)))

                def with_carry(c: Column) -> Column:
                    again = (old["carried"] > 0) & (c["k"] == own) & ((own == 0) | (c["tok"] + F.shiftright(old["carried"], 1) <= carry_most))

                    def placed(next_head: Column) -> Column:
                        tok = F.shiftright(next_head["carried"], 1)
                        apart = F.concat(out, F.array(part(next_head["text"], next_head["start"], at)))
                        return F.when((tok > 0) & (tok + n > max_tokens), alone(apart)).otherwise(state(out, next_head, at + 1, tok + n))

                    return bound(F.when(again, head(old["text"], old["start"], at, c["chars"] + old["carried"])).otherwise(head(nothing, at - c["k"], at, c["chars"])), placed, acc)

                return bound(F.aggregate(F.reverse(F.slice(chars, old["mid"] + 1, own)), seen_of(zero, zero, zero, F.lit(False)), back), with_carry, acc)

            def step(acc: Column, n: Column) -> Column:
                fits = (n <= max_tokens) & (~filled(acc) | (acc["tok"] + n <= max_tokens))
                return F.when(fits, state(acc["out"], acc["head"], acc["next"] + 1, acc["tok"] + n)).when(n > max_tokens, oversize(acc)).otherwise(overflow(acc, n))

            sizes = F.transform(chars, lambda n: F.shiftright(n, 1))
            parts = folded(sizes, state(no_parts, fresh(zero), zero, zero), no_parts, step, lambda acc: F.when(filled(acc), F.array(buffered(acc))).otherwise(no_parts))
            return F.transform(parts, lambda p: F.concat(p["text"], F.array_join(F.slice(found, p["start"] + 1, p["end"] - p["start"]), "")))

        return bound(F.transform(found, F.length), fold, no_chunks)

    all_chunks = bound(F.filter(segments(text, max_tokens), lambda s: ~blank(s)), packed, no_chunks)
    if clean:
        all_chunks = bound(all_chunks, lambda all_: F.filter(all_, lambda c, i: ~F.coalesce(F.get(all_, i - 1).endswith(c), F.lit(False))), no_chunks)
    return F.when(blank(text), no_chunks).otherwise(all_chunks)
