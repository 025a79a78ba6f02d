"""Problem 10: texts that were cut off before their end, by a stack automaton and baselines per source.

Every text runs through one automaton over its structural signs: brackets and quotes by kind, strings and escapes of
JSON, elements of markup, code fences. What is still open at its end is evidence. Where a source leaves such things
open in texts that are whole otherwise, its baseline takes the evidence away; the same holds for missing terminators.
What structure does not decide is judged by the words at which lines, list items and clauses end elsewhere.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.distribute import join_unique
from framewright.session import cut

#: Signs that end a sentence, and signs that may stand behind one.
TERMINATORS = ".!?。！？؟।۔．"
CLOSERS = "\"'”’»」』)]】）*_`"
SIGNS = TERMINATORS + CLOSERS + "“‘«「『【[（(,;:-–—#"
LEAD_SIGNS = SIGNS + "¿¡@„»"
ELLIPSIS = "…"
INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff\ufe0f"
#: Pairs of brackets and of directed quotes; elements without content, and those that may stay open.
BRACKETS = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "》": "《", "」": "「", "』": "『"}
QUOTES = {"”": "“„", "“": "„", "»": "«"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
MAY_STAY_OPEN = {"p", "li", "td", "tr", "th", "dt", "dd", "option", "thead", "tbody", "tfoot", "html", "body", "head"}
#: Signs between the columns of a table.
BARS = ("|", "¦", "│", "║")
#: Bits of what a text uses and of what is open at its end.
BRACKET, QUOTE, TAG = FEATURES = 1, 2, 4
#: A source leaves a feature open if at least this part of its distinct texts that use it and end like whole ones do
#: so; PRIOR_WEIGHT texts that close it are added. The same share is used for missing terminators.
STRAY_SHARE, BARE_SHARE = 0.3, 0.5
#: A line end is known if it is seen so often in places that weren't cut; a list word if it is seen there at all.
KNOWN_FROM = 3
#: A word is a usual end if at least this part of its occurrences stands before a sign that ends a clause or sentence.
END_RATE = 0.2
#: A source leaves its ends open if at least this part of its distinct texts ends openly and at no suspect word.
#: That counts as PRIOR_WEIGHT more occurrences of each word, all of them ends.
OPEN_SHARE, PRIOR_WEIGHT = 0.5, 10
#: A length is a limit of a source if so many distinct texts have it, PILE times as many as the lengths near it.
LIMIT_FROM, PILE, NEAR = 5, 4, 10

_TAG = re.compile(r"#?[^\s,#]+")
_SENTENCE_END = re.compile("[" + re.escape(TERMINATORS) + "]['\"”’»)\\]]*(?:\\s|$)")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_BROKEN_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{0,3})?$")
_JSON_START = re.compile(r"[\[{]\s*(?:[\"\[{\]}]|$)")
_JSON_SIGN = re.compile(r'\\.|["\[\]{}]|\\$', re.S)
_MARKUP = re.compile(r"<!--.*?-->|<!--.*$|<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*?)?(/?)>|<[/!]?[a-zA-Z][^<>]*$|<[/!]?$", re.S)
_PROSE_SIGN = re.compile("[" + re.escape("".join(BRACKETS) + "".join(BRACKETS.values()) + "“”„«»\"") + "]")
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+")


def json_open(text: str) -> bool | None:
    """Whether brackets or a string are still open at the end (JSON values, one after another); None if the text
    closes what it did not open, and so is no JSON."""
    stack, quoted = [], False
    for m in _JSON_SIGN.finditer(text):
        sign = m.group()
        if sign[0] == "\\":
            continue
        if sign == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif sign in "{[":
            stack.append(sign)
        elif not stack or stack.pop() != BRACKETS[sign]:
            return None
    return bool(stack) or quoted


def markup_state(text: str) -> tuple[bool, bool, bool]:
    """(uses markup, breaks off inside a tag or comment, elements are open at the end). Markup is a text that closes
    an element or begins with one and has another; a lone <word> is none."""
    stack: list[str] = []
    tags = 0
    used = inside = False
    for m in _MARKUP.finditer(text):
        name = m.group(2)
        if name is None:
            inside = not m.group().endswith("-->")
            used |= not inside
        elif m.group(1):
            if name.lower() in stack:
                used = True
                while stack.pop() != name.lower():
                    pass
        elif not m.group(3) and name.lower() not in VOID:
            tags += 1
            used |= tags > 1 and text.startswith("<")
            stack.append(name.lower())
    return used, inside and (used or text.startswith("<")), used and any(x not in MAY_STAY_OPEN for x in stack)


def prose_state(text: str) -> tuple[int, int]:
    """(features used, features open at the end) of brackets and quotes in the last paragraph. Closing signs close
    the last open one of their kind; signs of faces and inches open nothing."""
    paragraph = text[text.rfind("\n\n") + 1 :]
    stack: list[str] = []
    used = 0
    for m in _PROSE_SIGN.finditer(paragraph):
        sign, at = m.group(), m.start()
        before = paragraph[max(0, at - 2) : at]
        if before and (before[-1] in ":;=" or len(before) > 1 and before[1] in "-'" and before[0] in ":;="):
            continue
        if sign in BRACKETS or sign in QUOTES and any(x in stack for x in QUOTES[sign]):
            partners = BRACKETS.get(sign) or QUOTES[sign]
            place = max((len(stack) - 1 - stack[::-1].index(x) for x in partners if x in stack), default=-1)
            if place >= 0:
                used |= BRACKET if sign in BRACKETS else QUOTE
                del stack[place]
        elif sign == '"':
            if sign in stack:
                stack.remove(sign)
                used |= QUOTE
            elif not (before and before[-1].isdigit()):
                stack.append(sign)
        elif sign == "«" and "»" in stack:  # »so« in some languages
            stack.remove("»")
            used |= QUOTE
        elif sign != "”":
            stack.append(sign)
    left = 0
    for sign in stack:
        left |= BRACKET if sign in BRACKETS.values() else QUOTE
    return used | left, left


@functools.lru_cache(1 << 16)
def shape(token: str) -> str:
    """A token with digits as 0 and letters as a, runs as one."""
    return _RUNS.sub(lambda m: "0" if m.group()[0].isdigit() else "a", token)


def line_form(line: str) -> str | None:
    """The shape of the sign or number that a record line begins with; None if it begins with a word."""
    lead = line.split(None, 1)[0] if line.strip() else ""
    return lead_form(lead) if not lead.isalpha() else None


@functools.lru_cache(1 << 16)
def lead_form(lead: str) -> str | None:
    form = shape(lead)
    # a lone number, or a word with signs around it, is prose
    return None if not form or form in ("a", "0") or form.strip(LEAD_SIGNS) == "a" and "#" not in form else form


def line_word(line: str) -> str:
    """The last word of a record line as it is compared: words in lower case, anything else by its shape."""
    last = line.split()[-1]
    bare = last.strip(SIGNS)
    return bare.lower() if bare.isalpha() else shape(last)


def framed(lines: list[str]) -> bool | None:
    """Whether the last line ends with the bar that it begins with, if all lines like it do (rows of a table)."""
    sign = lines[-1][:1]
    if sign not in BARS:
        return None
    like = [x for x in lines[:-1] if x.startswith(sign)]
    if like and not all(x.endswith(sign) for x in like):
        return None
    return lines[-1].endswith(sign) and len(lines[-1]) > 1


def state_of(raw: str) -> tuple[str, str, int, int]:
    """(state, word, used, left) of a text that isn't blank; used and left are features used and left open.

    cut, whole: decided by the text alone, whole only if its source's baseline says so where something is left open.
    bare: sentences before, but no terminator at the end; cut, or open where a source mostly ends so. line, list:
    whole if `word` is known as an end of such lines. open: prose without any terminator, whole only if `word` is a
    usual end or its source leaves ends open and nothing speaks against `word`.
    """
    text = raw.strip().strip(INVISIBLE).rstrip()
    if not text:
        return "whole", "", 0, 0
    if text[-1] in (ELLIPSIS, "\ufffd") or text.endswith("..."):
        return "cut", "", 0, 0
    if _JSON_START.match(text):
        left = json_open(text)
        if left is not None:
            return ("cut" if left else "whole"), "", 0, 0
    fences = text.split("```")
    if len(fences) % 2 == 0:
        return "cut", "", 0, 0
    if text.endswith("```"):
        return "whole", "", 0, 0
    used = left = 0
    outside = " ".join(fences[::2])
    if "<" in outside:
        markup, inside, elements = markup_state(outside)
        if inside:
            return "cut", "", 0, 0
        used, left = TAG * markup, TAG * elements
        if markup:
            outside = _MARKUP.sub(" ", outside)
    more, open_ = prose_state(outside)
    used, left = used | more, left | open_
    lines = [x.strip() for x in text.split("\n")]
    framed_ = framed(lines)
    if framed_ is not None:
        return ("whole" if framed_ else "cut"), "", 0, 0
    if used & TAG and text.endswith(">"):
        return "whole", "", used, left
    bare = text.rstrip(CLOSERS)
    if bare and bare[-1] in TERMINATORS:
        return "whole", "", used, left
    if left & TAG or _BROKEN_ESCAPE.search(text):
        return "cut", "", 0, 0
    if text[-1] in "”’»」』)）" or text.endswith(('"', "'")) and bare and bare[-1].isalnum():
        return "whole", "", used, left
    tags = text.split()
    if "\n" not in text and len(tags) >= 2 and ("," in text or "#" in text) and all(_TAG.fullmatch(t.rstrip(",")) for t in tags) and not _SENTENCE_END.search(text) and is_list(text):
        return ("cut", "", 0, 0) if text[-1] in ",#" else ("list", tags[-1].lstrip("#").lower(), 0, 0)
    form = line_form(lines[-1])
    if form is not None and form[0] not in ">@#" or form and re.fullmatch("#+", form):
        if len(lines[-1].split()) > 1 and not _SENTENCE_END.search(lines[-1]):
            return "line", form + " " + line_word(lines[-1]), 0, 0
        if len(lines) > 1 and any(line_form(x) == form for x in lines[:-1]):
            return "cut", "", 0, 0
    if not text[-1].isalnum() and text[-1] not in ",;:-–—(<>/\\\"'%#@&" and ord(text[-1]) > 0x2000 and not "\u3040" <= text[-1] <= "\uffef":
        return "whole", "", used, left  # a picture sign
    if text[-1] in ",;:-–—/\\&":
        return "cut", "", 0, 0
    return ("bare" if _SENTENCE_END.search(text) else "open"), plain(re.split(r"[\s_]", text)[-1]), 0, left


def plain(token: str) -> str:
    """A word in lower case, without the signs around it."""
    return _EDGES.sub("", token.lower())


def word_in(token: str, last: bool) -> tuple[str, bool] | None:
    """(word, whether a clause or sentence ends behind it) of a token, if it stands at a place that surely holds whole
    words: inside a line, or before a terminator. last: it is the last one of its line."""
    core = token.rstrip(CLOSERS)
    if core.endswith(("...", ELLIPSIS)):
        return None
    ends = core[-1:] != "" and core[-1] in TERMINATORS
    word = token.lower().strip(SIGNS)  # not plain(): tags and code hold no words
    return (word, ends or core[-1:] in (",", ";", ":")) if (ends or not last) and word.isalpha() else None


def is_list(text: str) -> bool:
    """Words with commas behind nearly all of them, or with '#' before some and no commas at all."""
    words = text.split()
    commas = sum(w.endswith(",") for w in words)
    return commas >= len(words) - 1 or (commas == 0 and any(w.startswith("#") for w in words))


def known_ends(raw: str) -> list[tuple[str, str]]:
    """(state, word) of the inner places of a text where record lines or list words surely ended."""
    out = []
    lines = [x.strip() for x in raw.strip().split("\n")]
    for line in lines[:-1]:
        form = line_form(line)
        if form is not None and len(line.split()) > 1:
            out.append(("line", form + " " + line_word(line)))
    if len(lines) == 1 and lines[0] and not _SENTENCE_END.search(lines[0]) and is_list(lines[0]):
        out.extend(("list", w.strip("#,").lower()) for w in lines[0].split()[:-1])
    return out


def inspect(documents: DataFrame) -> DataFrame:
    """One row per document that isn't blank: doc_id, source, state, word, used, left, chars, bytes, text_key (of
    source and text)."""
    names = ["state", "word", "used", "left", "chars", "bytes", "text_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, source in zip(batch.column("text").to_pylist(), batch.column("source").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows.append((*state_of(text), len(text), len(raw), hashlib.blake2b(raw, digest_size=16, key=hashlib.blake2b(source.encode()).digest()).digest()))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *columns], names=["doc_id", "source", *names])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return usable(documents).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").mapInArrow(run, f"doc_id {kind}, source string, state string, word string, used int, left int, chars bigint, bytes bigint, text_key binary")


def usable(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id is not null and text is not null").where(F.col("text").rlike(r"[^\p{IsWhite_Space}]"))


def vocabulary(documents: DataFrame) -> DataFrame:
    """(state, word, times, ends) over the distinct texts: ends of record lines and list words by state; words of
    prose (state open), and how often a clause or sentence ends behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, ends = Counter(), Counter()
        for batch in batches:
            inner, final = Counter(), Counter()
            for text in batch.column("text").to_pylist():
                times.update(known_ends(text))
                for line in text.strip().split("\n"):
                    tokens = line.split()
                    final.update(tokens[-1:])
                    inner.update(tokens[:-1])
            # each spelling is looked at once a batch
            for counts, last in ((inner, False), (final, True)):
                for token, n in counts.items():
                    found = word_in(token, last)
                    if found:
                        times["open", found[0]] += n
                        ends["open", found[0]] += n * found[1]
            if len(times) > 200_000:
                yield counted(times, ends)
                times, ends = Counter(), Counter()
        yield counted(times, ends)

    def counted(times: Counter, ends: Counter) -> pa.RecordBatch:
        keys = list(times)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([times[k] for k in keys], pa.int64()), pa.array([ends[k] for k in keys], pa.int64())], names=["state", "word", "times", "ends"])

    counts = usable(documents).select("text").distinct().mapInArrow(run, "state string, word string, times bigint, ends bigint")
    return counts.groupBy("state", "word").agg(F.sum("times").alias("times"), F.sum("ends").alias("ends"))


def limits(texts: DataFrame) -> DataFrame:
    """(source, unit, length, exact): lengths in characters or bytes at which a source cuts. Many distinct texts have
    such a length, few the ones near it, and most of them are cut or end suspectly. A limit in bytes leaves up
    to three bytes less where a character doesn't fit any more (exact is false).

    texts: source, chars, bytes, odd (cut or suspect), distinct."""
    each = texts.select("source", "odd", F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")))).alias("x"))
    per = each.groupBy("source", "x.unit", "x.length").agg(F.count("*").alias("c"), F.count_if("odd").alias("o"))
    around = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-NEAR, NEAR)
    near = (F.sum("c").over(around) - F.col("c")) / (2 * NEAR)
    piles = per.withColumn("near", near).where((F.col("c") >= LIMIT_FROM) & (F.col("c") >= PILE * F.greatest("near", F.lit(1.0))) & (F.col("o") * 2 > F.col("c")))
    less = F.when(F.col("unit") == "bytes", F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))
    spread = piles.select("source", "unit", "length", F.explode(less).alias("less"))
    return spread.groupBy("source", "unit", (F.col("length") - F.col("less")).alias("length")).agg(F.max(F.col("less") == 0).alias("exact"))


def baselines(texts: DataFrame) -> DataFrame:
    """(source, strays, barely): the features that a source leaves open in texts that end like whole ones, and whether
    most of its texts that hold sentences end without a terminator. texts: distinct."""
    whole = F.col("state") == "whole"
    stray = lambda f: F.when(
        F.count_if(whole & (F.col("left").bitwiseAND(f) > 0)) >= STRAY_SHARE * (F.count_if(whole & (F.col("used").bitwiseAND(f) > 0)) + PRIOR_WEIGHT), F.lit(f)
    ).otherwise(F.lit(0))
    bare = F.count_if(F.col("state") == "bare")
    strays: Column = F.lit(0)
    for f in FEATURES:
        strays = strays + stray(f)
    return texts.groupBy("source").agg(strays.alias("strays"), ((bare >= KNOWN_FROM) & (bare >= BARE_SHARE * (bare + F.count_if(whole)))).alias("barely"))


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, truncated) of every document whose text is neither null nor blank.

    documents: doc_id, text, source; others are ignored; a null source is a source of its own. Rows without
    doc_id are left out. Baselines (features left open, missing terminators, known line ends and list words, usual
    ends, open ends per source, lengths that a source repeats) are counted over distinct texts, so copies have the
    verdict of one text; an open end is no evidence for itself. Texts that their own structure decides are joined
    with nothing; the others are judged once each, and the verdict goes to their copies.
    """
    docs = cut(inspect(documents).withColumn("settled", ((F.col("state") == "whole") & (F.col("left") == 0)) | (F.col("state") == "cut")))
    own = docs.where("settled").select("doc_id", "source", (F.col("state") == "cut").alias("truncated"))
    texts = cut(docs.drop("doc_id").dropDuplicates(["text_key"]))
    texts = cut(join_unique(texts, baselines(texts), "source"))
    state = F.when((F.col("state") == "bare") & F.col("barely"), "open").when(F.col("state") == "bare", "cut").otherwise(F.col("state"))
    state = F.when((state == "whole") & (F.col("left").bitwiseAND(F.bitwise_not(F.col("strays"))) > 0), "cut").otherwise(state)
    texts = texts.withColumn("state", state)
    words = cut(vocabulary(documents))
    asked = texts.where("state in ('open', 'line', 'list')").withColumn("asked", F.concat_ws(" ", "state", "word"))
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(40)) - 1), lambda n: F.substring(F.col("word"), F.lit(1), n))
    begun = words.where("state = 'open' and length(word) > 1").select(F.explode(prefixes).alias("word")).distinct()
    fragments = asked.where("state = 'open'").select("word").distinct().join(begun, "word", "left_semi").select(F.concat_ws(" ", F.lit("open"), "word").alias("asked"), F.lit(True).alias("begins"))
    known = asked.select("asked").distinct().join(words.select(F.concat_ws(" ", "state", "word").alias("asked"), "times", "ends"), "asked").join(fragments, "asked", "full")
    seen = join_unique(asked, known, "asked").na.fill(0, ["times", "ends"])
    usual = (F.col("times") > 0) & (F.col("ends") >= END_RATE * F.col("times"))
    odd = (F.col("times") > 0) & ~usual | (F.col("times") == 0) & F.col("begins").isNotNull()
    seen = cut(seen.withColumns({"odd": (F.col("state") == "open") & odd, "usual": usual}))
    every = texts.where("state in ('cut', 'whole')").withColumn("odd", F.col("state") == "cut").select("source", "state", "chars", "bytes", "odd").unionByName(seen.select("source", "state", "chars", "bytes", "odd"))
    limit = limits(every)
    openly = seen.where("state = 'open'").select("source", "text_key", F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")))).alias("x"), (F.col("chars") < F.col("bytes")).alias("wide"))
    full = openly.select("source", "text_key", "x.unit", "x.length", "wide").join(limit, ["source", "unit", "length"]).where("exact or wide").select("text_key", F.lit(True).alias("full")).distinct()
    share = every.groupBy("source").agg((F.count_if((F.col("state") == "open") & ~F.col("odd")) / F.count("*")).alias("share"))
    joined = join_unique(seen.join(full, "text_key", "left"), share, "source")
    # the prior of the source may speak for a word that is seldom seen, not against what is seen often
    prior = F.when(F.col("share") >= OPEN_SHARE, F.lit(PRIOR_WEIGHT)).otherwise(F.lit(0))
    ends = F.col("usual") | (prior > 0) & (F.col("ends") + prior >= END_RATE * (F.col("times") + prior))
    fragment = (F.col("times") == 0) & F.col("begins").isNotNull()
    truncated = (
        F.when(F.col("state") == "open", F.col("full").isNotNull() | fragment | ~ends)
        .when(F.col("state") == "list", F.col("times") == 0)
        .otherwise(F.col("times") < KNOWN_FROM)
    )
    verdict = joined.select("text_key", truncated.alias("truncated")).unionByName(texts.where("not settled and state in ('cut', 'whole')").select("text_key", (F.col("state") == "cut").alias("truncated")))
    judged_ = join_unique(docs.where("not settled").select("doc_id", "source", "text_key"), verdict.dropDuplicates(["text_key"]), "text_key", "inner").select("doc_id", "source", "truncated")
    return own.unionByName(judged_).withColumn("source", F.nullif("source", F.lit("")))


def found(documents: DataFrame) -> DataFrame:
    return judged(documents).where("truncated").select("doc_id").distinct()


def shares(documents: DataFrame) -> DataFrame:
    """Per source: texts that aren't blank, truncated ones, their share."""
    return judged(documents).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("truncated").alias("truncated")).withColumn("share", F.round(F.col("truncated") / F.col("texts"), 6))
