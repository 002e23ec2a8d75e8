"""Keyword-stuffed pages and link lists: block-wise compression ratio, confirmed by missing sentences.

A document's cells are cut into blocks; neighbours too short to judge are joined. A block's ratio is what it compresses to
over what ordinary text of its length and language does (``EXPECTED``, ``LANGUAGE``). Before it is compressed, a link, a
hashtag, an article's code and a number become one mark each: a list of them repeats its form, not its words, and so
becomes as redundant as a repeated keyword. A block is stuffing if its ratio is extreme, and the more sentence ends it
has, the more extreme it must be (``limit``). Logs, tables, traces, package lists and code are redundant too; they are told
by their numbers and brackets and never count. A document is reported if stuffing makes up more than half of its
characters.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.cells import PREFIX, blocks

#: Compressed over raw UTF-8 bytes of ordinary prose, by the power of two of its length: medians of the 28,000 blocks of
#: prose in 10,000 notebooks.
EXPECTED = {5: 0.95, 6: 0.82, 7: 0.69, 8: 0.62, 9: 0.57, 10: 0.50, 11: 0.46, 12: 0.43}
#: The same of other languages over English, over all lengths; those not listed compress as English does.
LANGUAGE = {"ru": 0.90, "ja": 1.06, "zh": 1.10}
#: A block without sentence ends is stuffing under this ratio; each sentence end in a hundred bytes takes off so much.
EXTREME, PER_SENTENCE = 0.88, 0.08
#: With so many of its own, as ordinary prose has, it never is.
DENSE = 0.9
#: A sentence of which the block's commonest pair of words makes up that much has no words of its own.
PHRASE = 0.25
#: Characters from which a block is judged by itself.
ALONE = 80
#: Least share of a document's characters.
LEAST = 0.5

META = re.compile(r'<meta\b[^<>]*?\bcontent=\\?["\']?')
LABELLED = re.compile(r"\[([^\[\]\n]*+)\]\((?:https?://|www\.)[^()\s]*+\)")
LINK = re.compile(r"""<a\s[^<>]*+>|</a>|(?:https?://|www\.)[^\s"'<>)\]]++""")
TAG = re.compile(r"</?[a-zA-Z!][^<>]*+>|<!--|-->")
HASHTAG = re.compile(r"(?<!\w)#\w+")
ARTICLE = re.compile(r"\b[A-Z]{2,5}-?\d{3,}\b")
NUMBER = re.compile(r"\d+(?:[.,:/]\d+)*")
LITERAL = re.compile(r'"""(.*?)(?:"""|\Z)|\'\'\'(.*?)(?:\'\'\'|\Z)|\[\s*("(?:[^"\\\n]|\\.){2,}"(?:\s*,\s*"(?:[^"\\\n]|\\.)*")+)\s*\]?|"((?:[^"\\\n]|\\.){60,})"|\'((?:[^\'\\\n]|\\.){60,})\'', re.DOTALL)
SENTENCE = re.compile(r"[.!?…:](?=\s|$)|[。！？]")
WORD = re.compile(r"[^\W\d_]+")
LOG_LINE = re.compile(r"^\W*(?:\w+\s)?(?:warn(?:ing)?|info|error|debug|trace|fatal|notice|critical)\b.{0,3}:?", re.IGNORECASE)
TRACE = re.compile(r'traceback \(most recent|^\s*file "|^\s*\w*(?:error|exception)\b')
RULE = re.compile(r"[\s|:+=-]+$")
MARK = re.compile("[\x02-\x04]")
COLUMN = re.compile(r"[^\s,] {2,}(?=\S)")
CODE_MARK = re.compile(r"[=(){}\[\]<>%\\]|\bimport\b|^[ \t]*(?:def|class|for|return|using|library|function|end)\b", re.MULTILINE)
IDEOGRAPH = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]")
KANA, HAN, CYRILLIC = re.compile("[\u3040-\u30ff]"), re.compile("[\u3400-\u4dbf\u4e00-\u9fff]"), re.compile("[\u0400-\u04ff]")


def language(text: str, said: str | None) -> str | None:
    """The language by the text's script where that tells it, else as said."""
    if not text.isascii():
        for k, script in (("ja", KANA), ("zh", HAN), ("ru", CYRILLIC)):
            if len(script.findall(text)) * 4 > len(text):
                return k
    return None if said in LANGUAGE else said


def expected_ratio(n_bytes: int, lang: str | None = None) -> float:
    """What ordinary text of the length and language compresses to."""
    x = min(max(math.log2(max(n_bytes, 32)), 5), 12)
    k = min(int(x), 11)
    return (EXPECTED[k] + (EXPECTED[k + 1] - EXPECTED[k]) * (x - k)) * LANGUAGE.get(lang, 1.0)


def condensed(text: str) -> str:
    """``text`` in lower case with one mark for each link, hashtag, article's code and number."""
    if "<" in text:
        text = META.sub("\x01", text)
    if "://" in text or "www." in text or "<a" in text:
        text = LINK.sub("\x02", LABELLED.sub("\\1\x02", text))
    if "<" in text:
        text = TAG.sub(" ", text)
    if "#" in text:
        text = HASHTAG.sub("\x03", text)
    return NUMBER.sub("0", ARTICLE.sub("\x04", text)).lower()


def redundancy(text: str, lang: str | None = None, form: str | None = None) -> float:
    """Compressed size over the expected one: 1 is ordinary, small is redundant. ``form``: what is compressed for it."""
    raw = text.encode("utf-8", "replace")
    small = raw if form is None else form.encode("utf-8", "replace")
    return max(0, len(zlib.compress(small, 6)) - 8) / max(1, len(raw)) / expected_ratio(len(raw), language(text, lang))


def like_data(form: str) -> bool:
    """Numbers, log lines, a trace or code make up the block; a line with a mark of a list is none of them."""
    if len(CODE_MARK.findall(form)) > 0.025 * len(form):
        return True
    lines = [x for x in form.split("\n") if x and not x.isspace()]
    data = [(not MARK.search(x) or len(COLUMN.findall(x)) > 1) and (RULE.match(x) is not None or x.count("0") > 0.1 * len(WORD.findall(x)) or bool(LOG_LINE.match(x)) or bool(TRACE.search(x))) for x in lines]
    if any("|" in x and RULE.match(x) for x in lines):  # a table with a ruled head
        data = [k or ("|" in x and not MARK.search(x)) for x, k in zip(lines, data)]
    traces = [i for i, x in enumerate(lines) if TRACE.search(x)]
    if len(traces) > 1:
        data[traces[0] : traces[-1] + 1] = [True] * (traces[-1] + 1 - traces[0])
    return 2 * sum(len(x) for x, k in zip(lines, data) if k) >= sum(map(len, lines))


def words(form: str) -> list[str]:
    """Words; an ideograph is one by itself."""
    return WORD.findall(form if form.isascii() else IDEOGRAPH.sub(r" \g<0> ", form))


def own_sentences(form: str) -> int:
    """Sentences with words of their own: several, mostly different, of which the block's commonest pair makes up little."""
    w = words(form)
    (phrase, times), *_ = Counter(zip(w, w[1:])).most_common(1) or [(("", ""), 0)]
    own = 0
    for x in SENTENCE.split(form)[:-1]:
        w = words(x)
        repeated = 2 * sum(p == phrase for p in zip(w, w[1:])) if times > 2 else 0
        own += len(set(w)) >= max(5, 0.7 * len(w)) and repeated < PHRASE * len(w)
    return own


def limit(form: str) -> float:
    """The ratio under which a block is stuffing, by the density of its own sentences' ends."""
    density = 100 * own_sentences(form) / max(1, len(form.encode("utf-8", "replace")))
    return EXTREME - PER_SENTENCE * density if density < DENSE else 0.0


def stuffed_chars(b: str, lang: str | None = None, depth: int = 0) -> int:
    """How many of a block's characters are stuffing."""
    n = len(b)
    if depth == 0:
        b = PREFIX.sub("", b)
        if '"' in b or "'" in b:
            bare = META.sub(" ", b) if "<meta" in b else b
            inner = [next(g for g in m.groups() if g is not None) for m in LITERAL.finditer(bare) if any(g is not None for g in m.groups())]
            if sum(map(len, inner)) > 60:
                # strings in code are judged by themselves
                got = sum(stuffed_chars(x.replace('", "', ", ").replace("', '", ", ").replace("\\n", "\n").replace('"', ""), lang, 1) for x in inner)
                return got + stuffed_chars(LITERAL.sub(" ", bare), lang, 1)
    form = condensed(b)
    r = redundancy(b, lang, form)
    if r >= EXTREME or r >= limit(form) or not WORD.search(form) and "\x02" not in form and "\x03" not in form:
        return 0
    return 0 if like_data(form) else n


def joined(parts: list[str]) -> Iterator[str]:
    """The blocks, neighbours under ``ALONE`` characters put together until they can be judged."""
    short: list[str] = []
    size = 0
    for b in parts:
        if len(b) >= ALONE:
            if short:
                yield "\n".join(short)
                short, size = [], 0
            yield b
        else:
            short.append(b.strip())
            size += len(short[-1])
            if size >= 4 * ALONE:
                yield "\n".join(short)
                short, size = [], 0
    if short:
        yield "\n".join(short)


def stuffed_share(text: str, lang: str | None = None) -> float:
    """Share of the cells' characters that stuffing makes up; 0 for texts without cells."""
    total = got = 0
    for b in joined(blocks(text)):
        n = len(b.strip())
        total += n
        got += min(n, stuffed_chars(b, lang))
    return got / total if total else 0.0


def find_stuffed(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and the stuffed share of every document (doc_id, text, lang) whose share is above ``least``.

    Null, empty and blank texts are never reported; a null or unknown language counts as English unless the script says
    otherwise. Whole texts count, however long; repeated rows are each judged. The scan has no shuffle and no state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares = [stuffed_share(t, k) for t, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            hit = [i for i, s in enumerate(shares) if s > least]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit, pa.int64())), pa.array([shares[i] for i in hit], pa.float64())], ["doc_id", "share"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.where(F.length("text") > 0).select("doc_id", "text", lang.alias("lang")).mapInArrow(run, "doc_id long, share double")
