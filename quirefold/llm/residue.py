"""Template residue and error pages: message templates from a fixed-depth tree, and unresolved slots.

Every text is cut into messages (lines and sentences; a message over ``LONGEST``
tokens into overlapping stretches).  Those that hold a cue (a stem of the wording
of servers, programs, notices and fillers) go down a tree of fixed depth: the
number of tokens, the first ``HEAD`` tokens, the last ``TAIL``, numbers masked.
Within a leaf the tokens of each position are counted over its messages; a token
that holds at least ``SHARE`` of its position, or can be part of a cue, stands in
the template, any other is a variable part.  A template is judged once, by its
two outermost members and by how many texts hold it: wording that says by itself
what the message is decides alone, weaker wording only where the template recurs
in ``RECURS`` texts.  The verdict goes to all members.  Should the two members
disagree, each member is judged by itself, so no message decides for another.

Slots that were never filled, and dumped empty values, can stand in any ordinary
sentence; they are looked for in the texts themselves.

Words are compared without accents, in lower case and normal width, with
letters of look-alike scripts and traditional forms of the cue words folded.

Defined cases: null, empty and blank texts are no cases; repeated rows and equal
texts are each judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import map_rows

HEAD, TAIL, LONGEST, OVERLAP = 4, 2, 64, 24
SHARE, RECURS = 0.3, 3
ANY = "<*>"

_MESSAGE = re.compile(r"\n+|(?<=[.!?])[\"”’)\]]?\s+(?=[^\sa-z])|(?<=[。！？])[」』”’）]?(?=.)|(?<=[”’\"」』])\s+")
_TOKENS = re.compile(r"[a-zà-ɏа-яё؀-ۿ]+(?:'[a-z]+)?|\d+|\S")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_LOOKALIKE = str.maketrans("аеорсхуіѕԁ", "aeopcxyisd")
#: Traditional forms of the characters of the cue words below.
_PLAIN = str.maketrans("務網關維護內錯誤響應時統繁登錄錯過會話檢測異訪問驗證沒權頁請啟開啓許瀏覽腳填寫處佔換補標題說試這裡該刪無連線後繼續顯示資找", "务网关维护内错误响应时统繁登录错过会话检测异访问验证没权页请启开启许浏览脚填写处占换补标题说试这里该删无连线后继续显示资找")

STATUS = (
    r"(?:not found|internal server error|bad gateway|service unavailable|gateway time-?out|request time-?out|too many requests|unauthori[sz]ed|forbidden|bad request"
    r"|method not allowed|payment required|gone|conflict|not implemented|temporarily unavailable)"
)
TOOL = r"(?:java ?script|client-side script(?:ing|s)?|(?:browser )?scripts?|scripting|cookies?)"
TURN = r"(?:enable|turn on|switch on|allow|activate|accept|permit)"
_SAYS = re.compile(
    "|".join(
        [
            # servers and programs
            rf"(?<![a-z])(?:error|http(?:/[\d.]+)?|status(?: code)?)\W{{0,3}}[45]\d\d(?![0-9a-z])",
            rf"(?<![0-9a-z])[45]\d\d\W{{1,4}}{STATUS}(?![a-z])",
            rf"(?<![a-z]){STATUS}\W{{0,3}}\(?[45]\d\d(?![0-9a-z])",
            rf"^\W*{STATUS}\W*$",
            r"^\W*[45]\d\d\W+(?=\D*(?:このページ|お探し|页面|服务))",
            r"traceback \(most recent call last\)",
            r"\bfile \"[^\"]+\", line \d+",
            r"\b(?:key|value|type|name|index|attribute|runtime|template|syntax|import|lookup|io|os|assertion)error\b\s*:",
            r"\b(?:null ?pointer|unhandled|uncaught)\w* exception|\bexception in thread\b|\bstack ?trace\b",
            r"could not connect to [^.]{0,60}(?:timed out|refused|reset)|\bconnection (?:timed out|refused|reset)\b",
            r"\baccess to [^.,]{1,60} (?:has been|is) denied\b|^\W*access denied\b|you do not have permission to (?:view|access)",
            r"your (?:session|login) (?:has )?(?:expired|timed out)|^\W*(?:please )?(?:sign|log) in again\b",
            r"something went wrong(?: on our (?:side|end))?\W*$|^\W*(?:an )?(?:unexpected )?error (?:has )?occurred",
            r"too many requests|\bslow down\W*$",
            r"^\W*please (?:try again(?: later)?|reload|refresh)\b",
            r"requested (?:address|page|url|resource) (?:was not|could not be|cannot be) (?:served|found|displayed)",
            r"this (?:page|site|document) (?:cannot|can't|could not) be (?:displayed|found|loaded|reached)|^\W*page not found",
            r"^\W*go back to the home ?page|checking your browser|verify (?:that )?you are (?:a )?human",
            r"temporarily (?:down|unavailable|offline)|under maintenance\W*$|scheduled maintenance\W*$",
            rf"\b{TURN} (?:\w+ ){{0,3}}?{TOOL}\b|{TOOL} (?:is|are|must be|has to be|have to be|needs? to be) (?:required|enabled|disabled|turned on|switched on|allowed)|(?:requires?|without) {TOOL}\b(?=.*(?:browser|page|site|view|continue))",
            # Chinese
            r"(?:服务器|系统|网关|网络|数据库)\W?(?:繁忙|维护中|正在维护|内部错误|响应超时|连接超时|出错|异常|无响应)",
            r"(?:登录|会话)已?(?:过期|失效)|检测到异常访问|没有权限(?:查看|访问)|请重新登录|请完成验证",
            r"(?:页面|网页|资源|地址|链接|文献|内容|网址)(?:不存在|已?被?(?:删除|移除)|未找到|找不到|(?:暂时|目前)?无法(?:显示|访问|打开)|需要登录)|请?稍后再试|请?刷新页面|请?返回首页",
            rf"(?:启用|打开|允许|开启)[^。，,.]{{0,14}}(?:javascript|脚本|cookie)|(?:javascript|脚本|cookie)[^。，,.]{{0,10}}(?:启用|打开|允许|开启|禁用)",
            # Japanese
            r"ログインの?(?:期限|有効期限)|セッション(?:の有効期限|が切れ|の期限)|再度ログイン|認証に失敗",
            r"アクセスが集中して|メンテナンスを行って|メンテナンス中|サーバーが?混み合って|サーバー(?:エラー|内部)",
            r"(?:お探しの|この|指定(?:された|の))(?:资料|資料|ページ|アドレス|url|サイト)は[^。]{0,16}(?:ません|削除され)|しばらくしてから(?:もう一度|再度)|[時时]間をおいて再度|最初からやり直して|エラー\s*\d{3}|アクセスが拒否",
            r"(?:javascript|cookie|スクリプト)[^。]{0,14}(?:有効|オンに|[許许]可)",
            # filler
            r"lorem ipsum|\bplaceholder (?:copy|text|content)|\bdummy text|^\W*(?:sample|example|filler) (?:paragraph|text|sentence|copy)\b|replace before publishing",
            r"(?:description|content|text|summary|abstract|title) (?:will be|to be) (?:added|supplied|provided|inserted)(?: later| soon| here)?|\b(?:content|text) (?:goes|comes) here\b|^\W*(?:coming soon|under construction)\W*$",
            r"\basdf\b|\bqwer(?:ty)?\b|\bx{3,}(?:\W+x{3,}){2,}",
            r"占位(?:文字|文本|符)|内容待(?:补充|添加|更新)|(?:示例|样例|测试|占位)(?:文本|文字|内容|段落)(?=\W*(?:$|示例|样例|测试|占位))|(?:测试){3,}|示例文本|此处(?:插入|填写|输入)|请填写",
            r"サンプルの?(?:文章|テキスト)(?:です)?|本文が入ります|ここに[^。]{0,8}(?:入力|入ります|記入)|ダミー(?:テキスト|文章)|仮の(?:文章|テキスト)",
        ]
    )
)
#: Wording that also stands in ordinary texts; it counts where its template recurs.
_MAY_SAY = re.compile(r"^\W*(?:loading|please wait|just a moment|redirecting|click here|skip to (?:main )?content|back to top|read more|no results found|nothing found|try again)\W*$")
_LATIN_FILLER = re.compile(r"\b(?:lorem\w*|ipsum\w*|dolor\w*|amet\w*|consec\w*|adipis\w*|elit\w*|tempor\w*|incidid\w*|labor[aei]\w*|magna\w*|aliq\w*|sit(?:am)?|quis\w*|nos(?:tr\w*)?|ven[ia]\w*|sed\w*|eiusm\w*|ut|et)\b")

NAME = r"[A-Za-z][A-Za-z]*(?:[ ._-]?[A-Za-z]+){0,3}"
SLOT = re.compile(
    "|".join(
        [
            r"\{\d{1,2}\}",
            r"\{\{[^{}\n]{0,60}\}\}",
            r"\{%[^{}\n]{0,60}%\}",
            r"<%=?[^<>\n]{0,60}%>",
            rf"[$#]\{{\s*{NAME}\s*\}}",
            rf"@@\s*{NAME}\s*@@",
            rf"%%?{NAME}%%?(?![\w%])",
            r"(?<![\w%])%(?:\([a-z_]+\))?[sdif](?!\w)",
            rf"__{NAME}__",
            rf"\[\[\s*{NAME}\s*\]\]",
            rf"[\[<(]\s*(?:INSERT|Insert|insert|ENTER|Enter|ADD|Add)\s+{NAME}(?:\s+(?:HERE|here))?\s*[\]>)]",
            rf"\[\s*(?:Your|YOUR|your)\s+{NAME}\s*\]",
            rf"<\s*{NAME}\s+(?:goes|comes)\s+here\s*>",
            rf"&lt;\s*/?{NAME}\s*&gt;",
            rf"[\[(<]\s*(?:TODO|TBD|FIXME|XXX)\b[^\])>\n]{{0,40}}[\])>]",
            r"\[object [A-Z]\w*\]",
            r"\bundefined[ ,]+undefined\b",
            r"(?<=[A-Za-z]):\s*(?:null|None|undefined|NaN|nil)(?!\w)",
            r"\b(?:null[ ,]+null|NaN[ ,]+NaN|None[ ,]+None)\b",
            r"[【\[(（［]\s*请?(?:请填写|填写|此处插入|此处填写|插入|输入)[^】\])）］\n]{1,12}[】\])）］]",
            r"[【\[(（［]\s*ここに[^】\])）］\n]{1,12}(?:入力|記入|入ります)[^】\])）］\n]{0,4}[】\])）］]",
            r"[○〇◯●]{2,}(?:様|さん|殿|先生|氏)",
            r"[×＊]{3,}(?:様|先生)",
        ]
    ),
    re.ASCII,
)


_ACCENTED = re.compile(r"[\u00c0-\u024f\u1e00-\u1eff]")
_MARKS = re.compile(r"[\u0300-\u036f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_FOLD = _LOOKALIKE | _PLAIN


def wide_form(text: str) -> str:
    """A text in normal width; its letters keep their case."""
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def folded(text: str) -> str:
    """A text as messages are compared."""
    if text.isascii():
        return text.lower()
    wide = wide_form(text)
    if _ACCENTED.search(wide):
        wide = unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", wide)))
    return _MARKS.sub("", wide).lower().translate(_FOLD)


def messages(text: str) -> list[list[str]]:
    """The messages of a text as lists of tokens; spaces between Latin words are not kept.

    Sentences are told by their capitals, so the text is cut before it is folded.
    """
    out = []
    for part in _MESSAGE.split(wide_form(text)):
        tokens = _TOKENS.findall(folded(part))
        if len(tokens) <= LONGEST:
            if tokens:
                out.append(tokens)
        else:
            out += [tokens[a : a + LONGEST] for a in range(0, len(tokens) - OVERLAP, LONGEST - OVERLAP)]
    return out


def leaf_of(tokens: list[str]) -> str:
    """The path of a message through the tree."""
    masked = ["0" if t.isdigit() else t for t in tokens]
    return "\x1f".join([str(len(tokens)), *masked[:HEAD], "", *masked[HEAD:][-TAIL:]])


def joined(tokens: list[str]) -> str:
    """Tokens as text again: a space between words, none beside ideographs and marks."""
    out: list[str] = []
    for a, b in zip(["", *tokens], tokens):
        if a and (a[-1].isalnum() or a == ANY or a in ".,:;)?!*>\"") and (b[0].isalnum() or b[0] in "(<\"") and not (_WIDE.match(b) or _WIDE.match(a)):
            if not (a in ".:-" and b.isdigit()):
                out.append(" ")
        out.append(b)
    return "".join(out)


#: A text in which none of these stands can say none of the above.
_STEMS = (
    "error|http|status|not found|gateway|unavailable|time-out|timeout|timed out|too many requests|unauthori|forbidden|bad request|not allowed|payment required|gone|conflict|not implemented"
    "|traceback|file \"|exception|stack trace|stacktrace|could not connect|connection|access|permission|session|login|sign in|log in|went wrong|slow down|please|requested|this page|this site"
    "|this document|page not found|home page|homepage|your browser|verify|maintenance|script|cookie|服务器|系统|网关|网络|数据库|登录|会话|检测到|权限|验证|页面|网页|资源|地址|链接|文献|内容|网址"
    "|稍后|刷新|首页|脚本|ログイン|セッション|認証|アクセス|メンテナンス|サーバー|お探し|ページ|资料は|資料は|アドレスは|サイトは|urlは|しばらく|時間を|时间を|最初から|エラー|スクリプト|lorem|placeholder"
    "|dummy|sample|example|filler|replace before|will be|to be|goes here|comes here|coming soon|under construction|asdf|qwer|xxx|占位|示例|样例|测试|此处|请填写|サンプル|本文が|ここに|ダミー|仮の"
    "|loading|just a moment|redirecting|click here|skip to|back to top|read more|no results|nothing found|try again"
).split("|")
_FILLERS = "lorem ipsum dolor amet consec adipis elit tempor incidid labor magna aliq sitam quis nostr venia eiusm".split()
#: Without any of these no slot can stand in a text.
_SLOT_STEMS = (
    "{{ {% <% ${ #{ @@ __ [[ %( insert enter add your goeshere comeshere &lt; todo tbd fixme xxx [object undefined null nan none :nil 填写 插入 输入 ここに ○○ 〇〇 ◯◯ ●● ○〇 〇○ ××× ***".split()
    + ["%" + c for c in "abcdefghijklmnopqrstuvwxyz"]
    + ["{%d" % i for i in range(10)]
)
_REPEATS = re.compile(r"(?<![a-z])([a-z]+)(?:[^a-z0-9]{0,3}\s\1){5}(?![a-z])")


@lru_cache(maxsize=1)
def _gate():
    """One automaton over the stems; each says whether it is a cue (1), a slot's (2) or both."""
    import ahocorasick

    kinds: dict[str, int] = {}
    for stems, kind in ((_STEMS, 1), (_FILLERS, 1), (_SLOT_STEMS, 2)):
        for stem in stems:
            stem = stem.replace(" ", "")
            kinds[stem] = kinds.get(stem, 0) | kind
    automaton = ahocorasick.Automaton()
    for stem, kind in kinds.items():
        automaton.add_word(stem, kind)
    automaton.make_automaton()
    return automaton


def cues(compact: str) -> int:
    """Which kinds of stems a folded text without white space holds."""
    found = 0
    for _, kind in _gate().iter(compact):
        found |= kind
        if found == 3:
            break
    return found


@lru_cache(maxsize=100_000)
def _is_latin_filler(word: str) -> bool:
    return bool(_LATIN_FILLER.fullmatch(word))


@lru_cache(maxsize=1)
def _literals() -> tuple[frozenset[str], tuple[str, ...]]:
    """The literal words and ideographs of the wordings, and their longer parts."""
    words = set(re.findall(r"[a-z']{2,}", re.sub(r"\\[a-zA-Z]", " ", _SAYS.pattern + _MAY_SAY.pattern)))
    wide = set(re.findall(r"[^\x00-\x7f]", _SAYS.pattern))
    return frozenset(words | wide), tuple(w for w in words if len(w) >= 5)


@lru_cache(maxsize=200_000)
def may_be_cue(token: str) -> bool:
    """Whether a token can be part of some wording, so that it is never a variable part."""
    whole, parts = _literals()
    if not token.isalnum() or token in whole or token.isdigit() and len(token) == 3 and token[0] in "45" or set(token) == {"x"}:
        return True
    return token.isascii() and (_is_latin_filler(token) or any(p in token for p in parts))


def is_residue(tokens: list[str], recurs: bool = False) -> bool:
    """The verdict on a message; ``recurs``: whether its template stands in several texts."""
    if next(_gate().iter("".join(tokens)), None):
        text = joined(tokens)
        if _SAYS.search(text) or recurs and _MAY_SAY.search(text):
            return True
    words = [t for t in tokens if t.isascii() and t.isalpha()]
    if len(words) >= 5:
        filler = sum(map(_is_latin_filler, words))
        if filler >= 0.7 * len(words) and len({w for w in words if len(w) > 3}) >= 2:
            return True
    if len(tokens) - len(set(tokens)) >= 5:
        same = 1
        for a, b in zip(tokens, tokens[1:]):
            same = same + 1 if a == b and a.isalpha() and a.isascii() else 1
            if same > 5:
                return True
    return False


def template_of(tokens: list[str], kept: set[tuple[int, str]]) -> list[str]:
    """A message with its variable parts left open: tokens neither ``kept`` in their leaf nor part of a cue."""
    return [t if (i, t) in kept or may_be_cue(t) else ANY for i, t in enumerate(tokens)]


def mine(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, leaf, message, slot): the messages of every text that hold a cue, and a row for each text with an unfilled slot.

    A text is folded and run through one automaton first; only one with a cue is
    cut into messages, only one with a slot's stem is searched for slots.
    """
    kind = dict(docs.dtypes)[key]

    def rows(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {key: [], "leaf": [], "message": [], "slot": []}
        for k, x in zip(c[key], c[text]):
            if not x or not x.strip():
                continue
            whole = folded(x)
            seen = cues("".join(whole.split()))
            repeats = _REPEATS.search(whole) is not None
            if seen & 1 or repeats:
                kept = dict.fromkeys("\x1f".join(m) for m in messages(x) if repeats or cues("".join(m)) & 1)
                for message in kept:
                    for name, v in zip(out, (k, leaf_of(message.split("\x1f")), message, False)):
                        out[name].append(v)
            if seen & 2 and SLOT.search(wide_form(x)):
                for name, v in zip(out, (k, None, None, True)):
                    out[name].append(v)
        return out

    found = map_rows(docs.where(F.length(text) > 0).select(key, text), f"`{key}` {kind}, leaf string, message string, slot boolean", rows)
    return found.withColumn("leaf", F.when(F.col("leaf").isNotNull(), F.xxhash64("leaf")))


def templates(mined: DataFrame) -> DataFrame:
    """(leaf, message, n, template, residue): the distinct messages of every leaf, the texts that hold them, their template and its verdict.

    A position of a leaf keeps at most 1 / SHARE tokens, so what is gathered of a
    leaf has a bound, however many messages it holds.
    """
    distinct = mined.where("leaf is not null").groupBy("leaf", "message").agg(F.count(F.lit(1)).alias("n"))
    placed = distinct.select("leaf", "n", F.posexplode(F.split("message", "\x1f")).alias("at", "token"))
    counts = placed.groupBy("leaf", "at", "token").agg(F.sum("n").alias("n"))
    leaves = distinct.groupBy("leaf").agg(F.sum("n").alias("of"))
    often = counts.join(leaves, "leaf").where(F.col("n") >= SHARE * F.col("of")).groupBy("leaf").agg(F.collect_list(F.struct("at", "token")).alias("kept"))

    def open_up(c: dict[str, list]) -> dict[str, list]:
        made = [template_of(m.split("\x1f"), {(k["at"], k["token"]) for k in kept or ()}) for m, kept in zip(c["message"], c["kept"])]
        return {k: c[k] for k in ("leaf", "message", "n")} | {"template": ["\x1f".join(t) for t in made]}

    opened = map_rows(distinct.join(often, "leaf", "left"), "leaf bigint, message string, n bigint, template string", open_up)
    groups = opened.groupBy("leaf", "template").agg(F.sum("n").alias("of"), F.min("message").alias("low"), F.max("message").alias("high"))

    def judge(c: dict[str, list]) -> dict[str, list]:
        out = []
        for of, *members in zip(c["of"], c["low"], c["high"]):
            a, b = (is_residue(m.split("\x1f"), of >= RECURS) for m in members)
            out.append(a if a == b else None)
        return {k: c[k] for k in ("leaf", "template", "of")} | {"verdict": out}

    judged = map_rows(groups, "leaf bigint, template string, of bigint, verdict boolean", judge)

    def settle(c: dict[str, list]) -> dict[str, list]:
        out = [is_residue(m.split("\x1f"), of >= RECURS) if v is None else v for m, of, v in zip(c["message"], c["of"], c["verdict"])]
        return {k: c[k] for k in ("leaf", "message", "n", "template")} | {"residue": out}

    return map_rows(opened.join(judged, ["leaf", "template"]), "leaf bigint, message string, n bigint, template string, residue boolean", settle)


def leaf_templates(verdicts: DataFrame) -> DataFrame:
    """(leaf, n, template) of every template of residue: the texts that hold it and its wording with variable parts open."""
    found = verdicts.where("residue").groupBy("leaf", "template").agg(F.sum("n").alias("n"))

    def rows(c: dict[str, list]) -> dict[str, list]:
        return {"leaf": c["leaf"], "n": c["n"], "template": [joined(t.split("\x1f")) for t in c["template"]]}

    return map_rows(found, "leaf bigint, n bigint, template string", rows)


def residue(mined: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """The keys of the texts that hold residue, each once."""
    bad = verdicts.where("residue").select("leaf", "message")
    by_message = mined.where("leaf is not null").select(key, "leaf", "message").join(bad, ["leaf", "message"], "left_semi").select(key)
    return by_message.unionByName(mined.where("slot").select(key)).distinct()
