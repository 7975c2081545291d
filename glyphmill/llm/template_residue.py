"""Problem 9: unfilled template gaps, filler, error pages and script notices in place of content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.lineage import spread

#: Sentences that the residue models start from.
FILLER = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
asdf asdf qwer qwer zxcv zxcv jkl; jkl; asdfasdf qwerty test test test123 1234 1234 aaaa aaaa xxx xxx blah blah
ㅁㄴㅇㄹ ㅁㄴㅇㄹ ㅋㅌㅊㅍ ㅋㅌㅊㅍ ㅂㅈㄷㄱ ㅁㄴㅇㄹ
This is placeholder text. This is sample text, please replace it. Sample text, please replace. Dummy text for layout only.
Main text goes here. Your text goes in this box. Insert your text here. Your story will appear here. Content coming soon.
Your headline will appear here. Paragraph one. Paragraph two. Paragraph three. Heading goes here. Dummy copy for the layout. This is stand-in copy. Placeholder copy, final wording to follow. Temporary copy. Mock copy. Write something in this space.
Add a description later. Insert a few lines about the shop later. Replace this paragraph with your own words. Text to follow. To be written.
견본 글입니다. 임시 글입니다. 이것은 견본 문장이니 바꿔 주세요. 내용을 입력하는 자리입니다. 설명이 들어갈 자리입니다. 나중에 교체 예정. 여기에 글을 넣으세요. 본문이 들어갈 자리입니다. 준비 중입니다. 여기에 본문이 들어갑니다. 여기에 제목이 들어갑니다. 임시 문구입니다. 이것은 예시 문장이니 바꿔 주세요. 가나다라마바사 가나다라마바사
Texto de ejemplo, sustitúyalo. Aquí va el texto principal. Este es un texto de relleno. Escriba aquí la descripción. Escriba algo aquí. Aquí va el título. Aquí va el texto. Texto de relleno, por favor sustituir. Pendiente de redactar.
这是示例文字,请替换。 此处填写正文。 占位文字。 这里是标题。 这里填写标题。 示例文本。 请在此处输入内容。 这里输入内容。 正文稍后补充。
"""
NOTICE = """
404 Not Found. The page you requested could not be found. Page not found. The requested URL was not found on this server.
500 Internal Server Error. The server has encountered an error and could not complete your request. Error 500. Error 503. Error 403.
503 Service Unavailable. The service is temporarily unavailable. Please try again later. Try again later. Bad gateway. Gateway timeout. Too many requests.
403 Forbidden. Access denied. You do not have permission to view this page. Your session has expired. Your session has ended. Please log in again. Log in again. Back to the home page.
This site is down for maintenance. The request timed out after 30 seconds. Gateway timed out. The connection to the database was lost. Connection reset. Could not load resource. Unhandled exception, trace. Rate limit reached, slow down.
Oops, something went wrong on our side. Whoops, something broke on our side. We could not find that page. The page you asked for does not exist. Nothing was found. The item behind this link is not here. The service is not responding. The server is unavailable right now. Unexpected token in response, the request failed.
HTTP error 502. Status 500. 400 Bad Request. 429 Too Many Requests. 404 - Not Found. 503 : Unavailable. 403 / Forbidden. Please retry. Checking your browser.
If the problem persists, contact the administrator. If the trouble lasts, write to the administrator. Something went wrong. Go back to the start page.
You need to enable JavaScript to run this app. Please enable JavaScript to continue. JavaScript is required to view this page. JavaScript is disabled in your browser. noscript: turn scripting on to continue
This page does not work without scripts. This viewer does not work without JavaScript. Allow scripts. Please allow scripts in your browser and load the page again. Please allow JavaScript in your browser and refresh.
Scripts and cookies are required here. Your browser blocks scripts. Your browser has disabled scripts; the viewer needs them. Sorry: JS is off, so nothing can be shown. Please enable cookies.
오류 404. 에러 500. 내부 서버 오류. 요청하신 페이지를 찾을 수 없습니다. 찾으시는 페이지를 찾을 수 없습니다. 잘못된 접근입니다. 접근이 거부되었습니다. 접근 권한이 없습니다.
시스템 점검 중입니다. 서버 점검 중입니다. 응답 시간이 초과되었습니다. 요청 시간이 초과되었습니다. 데이터베이스에 연결하지 못했습니다. 현재 서비스를 이용할 수 없습니다. 삭제되었거나 없는 주소입니다. 존재하지 않는 주소입니다. 열람 권한이 없습니다. 처리되지 않은 예외. 죄송합니다, 문제가 발생했습니다. 이런, 문제가 발생했습니다. HTTP 오류 500. 상태 코드 503. 요청이 너무 많습니다.
서비스를 사용할 수 없습니다. 일시적으로 서비스를 이용할 수 없습니다. 잠시 후 다시 시도해 주세요. 세션이 만료되었습니다. 다시 로그인하세요. 관리자에게 문의하세요. 첫 화면으로 돌아가기
자바스크립트를 켜 주세요. 자바스크립트를 허용해 주세요. 이 페이지를 보려면 자바스크립트가 필요합니다. 스크립트가 꺼져 있어 표시할 수 없습니다. 브라우저에서 스크립트가 차단되어 있습니다. 스크립트를 허용해야 볼 수 있습니다. 자바스크립트를 사용하도록 설정한 뒤 새로 고치세요.
Error 404. Página no encontrada. La página solicitada no existe. Error interno del servidor. Servicio no disponible por el momento. Acceso denegado. Inténtelo más tarde. Su sesión ha caducado. Vuelva a iniciar sesión. Volver al inicio. El sitio está en mantenimiento. Se agotó el tiempo de espera. Algo salió mal. Demasiadas solicitudes. No tiene permiso para ver esta página. Se perdió la conexión con la base de datos.
Active JavaScript para continuar. Active JavaScript para ver el mapa. Habilite los scripts y recargue. Esta página necesita scripts. Su navegador tiene los scripts desactivados.
错误 404。 找不到页面。 您请求的页面不存在。 服务器内部错误。 服务暂时不可用。 拒绝访问。 请稍后再试。 会话已过期,请重新登录。 返回首页。 系统维护中。 请求超时。 出现错误。 请求过多。 您没有权限访问。 无法连接数据库。
请启用JavaScript后再查看。 浏览器已禁用脚本。 此页面需要脚本支持。 请允许脚本并刷新页面。
"""
#: What a gap is called and how a hint in it is worded.
FIELDS = (
    "name shop name|owner|address|phone|phone number|date|price|title|city|region name|colour|sign colour|material|reviewer|tag|photo id|opened on|first line|author|company|email|description|"
    "이름|가게 이름|상호|주소|전화번호|날짜|촬영일|개업일|가격|제목|지역|간판 색|재질|검수자|작성자|설명|nombre|dirección|teléfono|fecha|precio|名称|地址|电话|日期|价格"
)
HINTS = ("your %s", "insert %s", "enter %s", "%s here", "add %s", "fill in %s", "%s 입력", "%s을 입력하세요", "%s를 입력하세요", "%s을(를) 여기에 적으세요", "여기에 %s 입력", "escriba %s aquí", "su %s", "请输入%s", "填写%s")

#: Gaps by grammar: marks that only templates use, and brackets whose inside the hint model decides.
GAP = regex.compile(
    r"\{\{+[#/^&!>]?\s*[\p{L}_][^{}\n\"]{0,60}\}\}+|\$\{\s*[\p{L}_][^{}\n\"]{0,60}\}|#\{\s*[\p{L}_][^{}\n\"]{0,60}\}"
    r"|\{%[^%{}\n]{1,60}%\}|<%[=-]?[^%<>\n]{1,60}%>|<<\s*[\p{L}_][^<>\n]{0,60}>>|\[\[\s*[\p{L}_][^\[\]\n]{0,60}\]\]"
    r"|@@[\p{L}_][\p{L}\p{N}_ ]{0,40}@@|%%[\p{L}_][\p{L}\p{N}_ ]{0,40}%%|%\([\p{L}_][\p{L}\p{N}_ ]{0,40}\)s|(?<![A-Za-z0-9_])__[\p{L}][\p{L}\p{N}_ ]{0,40}?__(?![A-Za-z0-9_])"
    r"|(?<![{$#])\{\s*[\p{L}_][\p{L}\p{N}_. ]{0,40}\}(?!\})|(?<![A-Za-z0-9%])%[\p{Lu}][\p{Lu}\p{N}_]{1,40}%(?![A-Za-z0-9%])"
    r"|\*\|[\p{L}_][\p{L}\p{N}_:. ]{0,40}\|\*|(?<![\p{L}\p{N}$])\$[\p{L}_][\p{L}\p{N}_]{1,40}\$|(?<![\p{L}\p{N}$])\$[\p{Lu}][\p{Lu}_]{2,40}(?![A-Za-z0-9$])"
)
HINTED = regex.compile(r"(?<!\[)\[\s*([\p{L}][^\[\]\n\"]{1,60})\](?!\])|(?<!<)<\s*([\p{L}][^<>\n\"=/]{1,60})>(?!>)|\(\s*([\p{L}][^()\n\"]{1,30}(?:\([^()\n]{1,4}\))?[^()\n\"]{1,40})\)|«\s*([\p{L}][^«»\n\"]{1,40}?)\s*»")
QUOTES = "\"“”'‘’`«»「」『』"
FIELD_SET = frozenset(FIELDS.split("|"))
HINT_WORD = regex.compile("|".join(sorted({rf"(?<![a-z]){regex.escape(w)}(?![a-z])" for h in HINTS for w in h.replace("%s", " ").split()}, key=len, reverse=True)), regex.IGNORECASE)
MARKUP = regex.compile(r"(?i)(?:h[1-6]|p|br|hr|b|i|u|em|strong|a|div|span|ul|ol|li|table|tr|td|th|html|body|head|title|pre|code|img)")

_PIECE = regex.compile(r"[^\n.!?。？！…|]+(?:[.!?。？！…](?=\S)(?<![。？！…])[^\n.!?。？！…|]*)*[.!?。？！…|]*")
ORDERS, BITS = (3, 4, 5), 18
SLOTS = len(ORDERS) << BITS
#: Grams of prior weight per order, the score from which a piece trains the residue model, and the letters from which a
#: piece's score stands by itself; that of fewer letters is averaged with DOUBT_GRAMS grams of the score DOUBT.
PRIOR, SURE, LEAST_RUN = 400.0, 0.8, 8
DOUBT, DOUBT_GRAMS = -1.0, 4
#: Neighbouring short pieces that are judged together, at most.
WINDOW = 3
#: A piece is residue from STRONG on; one next to residue, to either side, already from WEAK on.
STRONG, WEAK = -0.4, -1.2

_ALNUM = np.array([chr(o).isalnum() for o in range(0x10000)])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def slots(code: np.ndarray) -> list[np.ndarray]:
    """Hashed n-gram slots per order, aligned with the start of the gram."""
    out = []
    h = code * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, ORDERS[-1] + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + code[n - 1 :] * np.uint64(0x94D049BB133111EB)
        if n in ORDERS:
            out.append(((h >> np.uint64(64 - BITS)) + np.uint64(ORDERS.index(n) << BITS)).astype(np.int64))
    return out


def counted(texts: list[str]) -> np.ndarray:
    """Gram counts over the lines of some texts."""
    total = np.zeros(SLOTS)
    for text in texts:
        for line in text.split("\n"):
            for s in slots(_codes(line.strip())):
                total += np.bincount(s, minlength=SLOTS)
    return total


def ratios(residue: np.ndarray, natural: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of every slot, each order on its own, both smoothed towards their common mean."""
    out = np.zeros(SLOTS, dtype=np.float32)
    for k in range(len(ORDERS)):
        part = slice(k << BITS, (k + 1) << BITS)
        r, n = residue[part], np.maximum(natural[part], 0)
        base = (r / max(r.sum(), 1) + n / max(n.sum(), 1)) / 2 + 1e-9
        p = (r + PRIOR * base) / (r.sum() + PRIOR)
        q = (n + PRIOR * base) / (n.sum() + PRIOR)
        out[part] = np.clip(np.log(p) - np.log(q), -4, 4)
    return out


def pieces(text: str, table: np.ndarray) -> list[tuple[int, int, int, float]]:
    """``(start, end, letters, score)`` of the sentences and lines of a text; score: mean log likelihood ratio of the grams."""
    code = _codes(text)
    if len(code) != len(text):  # lower case that changes the length
        text = text.lower()
    per = np.zeros(len(code) + 1)
    for s in slots(code):
        per[: len(s)] += table[s]
    total = np.concatenate([[0.0], np.cumsum(per / len(ORDERS))])
    letters = np.concatenate([[0], np.cumsum(_ALNUM[np.minimum(code, 0xFFFF).astype(np.int64)] | (code > 0xFFFF))])
    out = []
    for m in _PIECE.finditer(text):
        a, b = m.start(), m.end()
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if b - a >= ORDERS[0]:
            n = b - a - ORDERS[0] + 1
            out.append((a, b, int(letters[b] - letters[a]), float(total[a + n] - total[a]) / n))
    return out


def weighed(found: list[tuple[int, int, int, float]]) -> list[float]:
    """The scores of some pieces, short ones judged by all their grams.

    Pieces under LEAST_RUN letters count alone and in windows with neighbouring short ones, the best of these scores
    is theirs. In a window of few letters a score weighs by the number of grams, so one chance gram decides nothing.
    """
    out = [p[3] for p in found]
    short = [p[2] < LEAST_RUN for p in found]
    for i, p in enumerate(found):
        if short[i]:
            out[i] = -np.inf
    for i in range(len(found)):
        total, n, letters = 0.0, 0, 0
        for j in range(i, min(i + WINDOW, len(found))):
            if not short[j]:
                break
            a, b, own, score = found[j]
            k = b - a - ORDERS[0] + 1
            total, n, letters = total + score * k, n + k, letters + own
            mean = total / n if letters >= LEAST_RUN else (total + DOUBT * DOUBT_GRAMS) / (n + DOUBT_GRAMS)
            out[i : j + 1] = [max(x, mean) for x in out[i : j + 1]]
    return out


def sure(text: str, table: np.ndarray) -> list[str]:
    """The pieces of a text that train the residue model."""
    found = pieces(text, table)
    return [text[p[0] : p[1]] for p, score in zip(found, weighed(found), strict=True) if score >= SURE]


def hint_table(natural: np.ndarray) -> np.ndarray:
    """The model of hints in gaps against natural prose."""
    fields = FIELDS.split("|")
    return ratios(counted([h % f for h in HINTS for f in fields] + fields), natural)


def gaps(text: str, hints: np.ndarray) -> list[tuple[int, int]]:
    """Spans of unfilled template gaps. What stands between quotation marks is quoted, no gap."""
    found = [m.span() for m in GAP.finditer(text) if not (m.start() and m.end() < len(text) and text[m.start() - 1] in QUOTES and text[m.end()] in QUOTES)]
    for m in HINTED.finditer(text):
        inside = next(g for g in m.groups() if g)
        if m.group(2) and MARKUP.fullmatch(inside.strip()):
            continue
        field = inside.strip().lower().replace("_", " ") in FIELD_SET
        if (m.group(3) or m.group(4) and not field) and not HINT_WORD.search(inside):  # round brackets and guillemets are ordinary punctuation
            continue
        scores = [hints[s].mean() for s in slots(_codes(inside)) if len(s)]
        if (scores and sum(scores) / len(scores) > 0) or ((m.group(2) or m.group(4)) and field):
            found.append(m.span())
    return found


def residue_runs(text: str, table: np.ndarray) -> tuple[int, int, bool]:
    """``(letters in residue pieces, letters in all, residue closes the text)``.

    Every piece is judged. A short one that is no residue even next to some parts no neighbours and does not close the text.
    """
    found = pieces(text, table)
    total = sum(p[2] for p in found)
    found = [(p[2], score) for p, score in zip(found, weighed(found), strict=True) if score > WEAK or p[2] >= LEAST_RUN]
    hit = [score > STRONG for _, score in found]
    for order in (range(1, len(found)), range(len(found) - 2, -1, -1)):
        step = -1 if order.step == 1 else 1
        for i in order:
            hit[i] = hit[i] or (hit[i + step] and found[i][1] > WEAK)
    return sum(n for (n, _), h in zip(found, hit, strict=True) if h), total, bool(hit and hit[-1])


def judged(text: str | None, table: np.ndarray, hints: np.ndarray) -> tuple[int, float, bool]:
    """``(gaps, coverage, found)``: found if a gap is open, or residue is most of the text or closes it."""
    if not text:
        return 0, 0.0, False
    g = len(gaps(text, hints))
    got, total, closes = residue_runs(text, table)
    cover = got / total if total else 0.0
    return g, cover, bool(g) or cover >= 0.5 or (closes and got > 0)


def _summed(df: DataFrame, text: str, chosen) -> np.ndarray:
    """Gram counts of what ``chosen`` takes of all rows: dense per task, sparse to the shuffle, at most SLOTS rows to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS)
        for batch in batches:
            grams = [s for t in batch[text] if t for part in chosen(t) for s in slots(_codes(part))]
            if grams:
                total += np.bincount(np.concatenate(grams), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "n": total[at]})

    rows = df.select(text).mapInPandas(run, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS)
    got = rows.toPandas()
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def fit(documents: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Residue and hint tables fitted on all documents.

    Natural prose is counted over the whole corpus, the residue models start from the sentences above. One more pass
    moves the pieces that score SURE or more from natural prose to residue, so wordings that the start lacks are
    learned and the corpus's own sentences that merely mention errors or templates count as prose. The tables have a
    fixed size (SLOTS floats), whatever the corpus.
    """
    start = counted([FILLER, NOTICE])

    natural = _summed(documents, text, lambda t: [t])
    first = documents.sparkSession.sparkContext.broadcast(ratios(start, natural))
    moved = _summed(documents, text, lambda t: sure(t, first.value))
    weight = max(1.0, moved.sum() / max(start.sum(), 1) / 4)
    natural = natural - moved
    return ratios(start * weight + moved, natural), hint_table(natural)


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, gaps, coverage, found)``: a row per document.

    ``gaps`` counts open template gaps, ``coverage`` is the share of letters in residue pieces. Null and empty texts
    have no gaps, coverage 0 and are not found. Whole texts are read; repeated keys give a row each; other columns are
    ignored.
    """
    rows = spread(documents.select(key, text))
    table, hints = fit(rows, text)
    sc = documents.sparkSession.sparkContext
    both = sc.broadcast((table, hints))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, h = both.value
        for batch in batches:
            got = [judged(x, t, h) for x in batch[text]]
            yield pd.DataFrame({key: batch[key], "gaps": [g[0] for g in got], "coverage": [g[1] for g in got], "found": [g[2] for g in got]})

    return rows.mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, gaps int, coverage double, found boolean")
