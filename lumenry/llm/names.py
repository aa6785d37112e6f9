"""Variant spellings of organisation names, linked across records."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Legal forms, words that say nothing, and trades, as they end company names.
_LEGAL = frozenset("ltd limited aktiengesellschaft gesellschaft sociedad anonima societe anonyme gmbh inc incorporated llc llp lp sa sas sarl ag kg ohg ug bv nv co plc company corp corporation pty spa srl oy ab as".split())
_NOISE = frozenset("the official online hq headquarters and und y et de page site website homepage".split())
_TRADES = (
    "associates automation analytics brothers communications consulting department_store development distribution engineering group holdings industries insurance international "
    "laboratories logistics management manufacturing marketing pharmaceuticals publishing research_group services software solutions systems technologies media networks data cloud_services foods energy finance capital trading design studio security health education travel"
).split()
_PARTS = {w for t in _TRADES for w in t.split("_")} | {"research", "department", "store"}
_CJK_LEGAL = re.compile(r"(?:股份有限公司|有限责任公司|股份公司|有限公司|责任公司|集团公司|总公司|分公司|公司|集团)+$")
_CJK_TRADES = ("信息技术", "云服务", "人工智能", "科技", "智能", "营销", "软件", "咨询", "网络", "传媒", "数据", "技术", "贸易", "物流", "教育", "文化", "广告", "电子", "实业", "服务", "管理", "设计", "医药", "能源", "金融", "投资")
# Traditional and simplified forms of characters that are usual in company names, pair by pair.
_TRADITIONAL = "傳雲瀾網絡硯嶼謙術銘嵐葦燁鈞楓務啟團嶠彥恆據數暉橋潯灣營軟銷霽澤陽東華國龍鳳馬門開長張陳劉吳趙楊黃孫鄭馮蔣韓鄧許蘇呂葉蕭鐘陸萬錢嚴賴顧業產發廣慶應電飛機車運達遠聯適醫藥衛環瑪礦種範築級純結統維綱線編總績聖聲興蘭裝製見視計訊設證試誠論諾護豐貨貿資賢質輝輸釋銀銅銳鋁錄錦鏡鐵間閣際雙離靈順領題顯風館駿騰驗體鴻鵬麗齊"
_SIMPLIFIED = "传云澜网络砚屿谦术铭岚苇烨钧枫务启团峤彦恒据数晖桥浔湾营软销霁泽阳东华国龙凤马门开长张陈刘吴赵杨黄孙郑冯蒋韩邓许苏吕叶萧钟陆万钱严赖顾业产发广庆应电飞机车运达远联适医药卫环玛矿种范筑级纯结统维纲线编总绩圣声兴兰装制见视计讯设证试诚论诺护丰货贸资贤质辉输释银铜锐铝录锦镜铁间阁际双离灵顺领题显风馆骏腾验体鸿鹏丽齐"
_SIMPLER = str.maketrans(_TRADITIONAL, _SIMPLIFIED)
# Usual short forms of trades that are no beginnings of them.
_SHORT = {"dept": "department", "grp": "group", "intl": "international", "sw": "software", "mfg": "manufacturing", "mktg": "marketing", "svc": "services", "svcs": "services", "bros": "brothers", "labs": "laboratories", "comms": "communications", "mgmt": "management", "hw": "hardware", "tech": "technologies", "sys": "systems", "dev": "development"}
# Usual short forms of given names.
_SHORT_NAMES = {
    "alexander": "alex sasha sandy xander lex", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "charles": "chuck charlie", "christopher": "chris kit", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "edward": "ed eddie ned ted",
    "elizabeth": "liz beth betty lisa eliza libby", "francisco": "paco pancho paquito fran", "frederick": "fred freddy fritz", "gabriela": "gabi gaby ela", "gregory": "greg", "guadalupe": "lupe lupita", "henry": "hank harry hal", "james": "jim jimmy", "johannes": "jo hans hannes jan",
    "jolanta": "jo jola", "jonathan": "jon jonny", "joseph": "joe joey", "josephine": "jo josie", "katherine": "kate kathy katie kitty", "leonie": "leo", "margaret": "meg maggie peggy greta rita", "matthew": "matt", "michael": "mike mick mickey", "nicholas": "nick nicky klaus claus nico",
    "patricia": "pat patty trish", "rebecca": "becky becca", "richard": "dick rick rich ricky", "robert": "bob bobby rob bert", "samuel": "sam sammy", "stephen": "steve", "susanna": "sue susie suzy susi", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy",
    "ursula": "ulla uschi", "victoria": "vicky vicki tori", "william": "bill billy will willy liam", "zachary": "zach zack",
}
_CJK = re.compile(r"[一-鿿]")
_DOTTED = re.compile(r"\b(?:[^\W\d_]\.){2,}(?=\W|$)")
_WORD = re.compile(r"[^\W\d_]+\.?")
_HOSTS = frozenset("www m shop en de fr es zh cn mobile web sites site hub".split())
_PATHS = frozenset("index html about start home en tenant company companies user users profile store shop listing directory".split())


def fold(text: str) -> str:
    """Lower case without accents, in compatible forms."""
    low = unicodedata.normalize("NFKC", text).lower().replace("ß", "ss")
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c)))


def sound(token: str) -> str:
    """A Latin token in one spelling of its sounds: c, ck, q as k, ph as f, w as v, y as i."""
    return token.replace("ck", "k").replace("ph", "f").translate(_SOUNDS)


_SOUNDS = str.maketrans("cqwy", "kkvi")


_NICKNAMES: dict[str, tuple[str, ...]] = {}
for _name, _shorts in _SHORT_NAMES.items():
    for _short in _shorts.split():
        _NICKNAMES[sound(_short)] = (*_NICKNAMES.get(sound(_short), ()), sound(_name))


def nickname(short: str, long: str) -> bool:
    """Whether a token is a usual short form of a given name, or the beginning of one."""
    return long in _NICKNAMES.get(short, ()) or (len(short) >= 3 and len(long) >= 5 and long.startswith(short) and len(short) < len(long) - 1)


def near(a: str, b: str) -> bool:
    """Whether two texts differ by at most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return (a[i + 1 :] == b[i:]) if len(a) > len(b) else (a[i:] == b[i + 1 :])


def abbreviates(short: str, long: str) -> bool:
    """Whether a token is an initial, a beginning, or letters in order from the beginning of another."""
    if not short or len(short) >= len(long) or short[0] != long[0]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


@lru_cache(maxsize=100_000)
def trade(word: str, dotted: bool) -> str | None:
    """The trade a token names, in full, abbreviated or with a slip; None for other tokens."""
    if word in _PARTS:
        return word
    if word in _SHORT:
        return _SHORT[word]
    if len(word) >= 6:
        close = [p for p in sorted(_PARTS) if near(word, p)]
        if close:
            return close[0]
    if len(word) >= 3 and (dotted or len(word) >= 4):
        begun = [p for p in sorted(_PARTS) if p.startswith(word)]
        if begun and (dotted or len(word) >= 4):
            return begun[0]
    if (dotted and len(word) >= 2) or (len(word) >= 5 and not re.search(r"[aeiou]{1}[^aeiou][aeiou]", word)):
        inside = [p for p in sorted(_PARTS) if abbreviates(word, p) and len(word) * 2 >= len(p)]
        if inside:
            return inside[0]
    return None


def parse_name(name: str) -> tuple[str, str, str, str]:
    """(core, trade, initials, Latin alias) of a name; the core's tokens are sorted.

    Legal forms, empty words, accents, case, punctuation and order are taken away. A name that is
    only initials has no core. Of a Chinese name the core is its characters, simplified, without
    place in brackets, trade and legal form; Latin words beside it are its alias.
    """
    typed = re.sub(r"(?<=[a-zà-ÿ]{2})(?=[A-Z][a-zà-ÿ]{2})", " ", unicodedata.normalize("NFC", name or ""))
    text = fold(typed).translate(_SIMPLER)
    if len(_CJK.findall(text)) >= 2:
        alias = [w for w in re.findall(r"[a-z]+", text) if w not in _LEGAL and w not in _NOISE and trade(w, False) is None]
        inner = re.sub(r"[（(【\[][^（()）】\]]*[）)】\]]", "", text)
        kept = "".join(_CJK.findall(inner if len(_CJK.findall(inner)) >= 2 else text))
        bare = _CJK_LEGAL.sub("", kept)
        of = next((t for t in _CJK_TRADES if bare.endswith(t) and len(bare) - len(t) >= 2), "")
        core = bare[: len(bare) - len(of)] if of else bare or kept
        return re.sub(r"^.{2,4}[市省县区](?=.{3})", "", core), of, "", " ".join(alias)
    text = _DOTTED.sub(lambda m: m.group().replace(".", "") + " ", text)
    words = _WORD.findall(text.replace("'", ""))
    core, of = [], []
    for w in words:
        bare = w.rstrip(".")
        if bare in _LEGAL and len(words) > 1 or bare in _NOISE and not (len(bare) == 1 and w != bare):
            continue
        t = trade(bare, w != bare) if len(words) > 1 else None
        (of if t else core).append(t or bare)
    if not core and of == ["group"] and words[0].rstrip(".") in _LEGAL | _NOISE:
        core = [words[0].rstrip(".")]
    if not core and of:
        core, of = of, []
    if not core and words:  # all words are legal forms or empty ones, such as initials that read like one
        core = [words[0].rstrip(".")]
    initials = ""
    if len(core) == 1 and set(of) <= {"group"} and len(core[0]) >= 2 and len(core[0]) <= 5 and (name or "").strip()[:2].replace(".", "").isupper():
        initials, core, of = core[0], [], []
    return " ".join(sorted(map(sound, core))), " ".join(sorted(set(of))), initials, ""


def parse_url(url: str) -> tuple[str, str, str]:
    """(domain, label of the domain, tenant): the tenant is the subdomain or the first telling word of the path."""
    text = re.sub(r"^[a-z]+:/+", "", fold(url or "").strip())
    host, _, path = text.partition("/")
    host = re.sub(r":\d+$", "", host.rpartition("@")[2])
    labels = [x for x in host.split(".") if x]
    if len(labels) < 2 or not re.search(r"[a-z]", labels[-1]) or not re.fullmatch(r"[a-z0-9.-]+", host):
        return "", "", ""
    sub = [x for x in labels[:-2] if x not in _HOSTS]
    steps = [re.sub(r"-\d+$", "", s) for s in re.split(r"[?#]", path)[0].split("/")]
    tenant = next((s for s in [*sub, *steps] if re.fullmatch(r"[a-z-]{4,}", s) and s not in _PATHS), "")
    return ".".join(labels[-2:]), labels[-2], tenant


def parse_slug(slug: str) -> tuple[str, str, str]:
    """(core with sorted tokens, trade, initials in order) of a label such as get-name-trade or name-hq."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"^get-?(?=[a-z]{5})", "", slug)) if w and w not in _NOISE and w not in _LEGAL]
    of = sorted({t for w in words[1:] if w in _PARTS and (t := trade(w, False))})
    core = [w for i, w in enumerate(words) if not i or w not in _PARTS]
    return " ".join(sorted(map(sound, core))), " ".join(of), "".join(w[0] for w in core)


def shortened(token: str) -> list[str]:
    """The token with each of its characters deleted once (symmetric deletion)."""
    return [token[:j] + token[j + 1 :] for j in range(len(token))]


def keys(core: str, trade: str = "", founded: str = "") -> list[str]:
    """Neighbourhood keys of a core: names at most one edit of one token, one initial or one Chinese place prefix apart share one.

    Every token of two or more letters is deleted at each place once, the others staying (symmetric
    deletion), and reduced to its initial; the rest is sorted, so that order does not matter. With a
    date each single token, shortened or not, is a key beside the date, so that names of one date may
    differ in all tokens but one, and the initials of core and trade are one, too. Tokens written
    together are a key in either order.
    """
    if _CJK.search(core):
        out = {core, *shortened(core)} if len(core) >= 3 else {core}
        return sorted({f"d:{x}" for x in out} | ({f"d:{core[-n:]}" for n in (3, 4)} if len(core) >= 5 else set()))
    tokens = core.split()
    out = {"d:" + core} if core else set()
    for i, t in enumerate(tokens):
        rest = tokens[:i] + tokens[i + 1 :]
        if len(t) >= 2:
            out |= {"d:" + " ".join(sorted([*rest, x])) for x in shortened(t)}
        if rest:
            out.add("i:" + " ".join(sorted(rest)) + ":" + t[0])
        if founded and len(t) >= 4:
            out |= {f"f:{x}|{founded}" for x in (t, *shortened(t))}
        for full in _NICKNAMES.get(t, ()) if rest else ():
            out.add("d:" + " ".join(sorted([*rest, full])))
            out.update("d:" + " ".join(sorted([*rest[:k], x, *rest[k + 1 :], full])) for k, r in enumerate(rest) if len(r) >= 5 for x in shortened(r))
    if founded and tokens and trade:
        out.add("n:" + "".join(sorted(w[0] for w in (*tokens, *trade.split()))) + "|" + founded)
    if tokens and len("".join(tokens)) >= 8:
        out |= {"j:" + "".join(tokens), "j:" + "".join(reversed(tokens))}
    return sorted(out)


def _joined(a: list[str], b: list[str]) -> bool:
    """Whether two names are one slip apart if their tokens are written together, in rising or falling order."""
    return any(near("".join(x), "".join(y)) for x in (a, a[::-1]) for y in (b, b[::-1]))


def cheapest(cost: list[list[float]]) -> list[int]:
    """The column of each row in an assignment of least cost (Hungarian method); needs as many columns as rows."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        of[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while of[j0]:
            used[j0], i0, delta, j1 = True, of[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            of[j0], j0 = of[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if of[j]:
            out[of[j] - 1] = j - 1
    return out


#: Costs of a pair of tokens: a slip, an initial or short given name, an abbreviation, and no likeness at all.
SLIP, INITIAL, CUT, NONE = 1.0, 1.1, 1.2, 100.0


def token_cost(s: str, t: str) -> float:
    """0 for equal tokens, else the cost of the slightest likeness between them."""
    if s == t:
        return 0.0
    short, long = sorted((s, t), key=len)
    if len(short) == 1:
        return INITIAL if long[0] == short else NONE
    if nickname(s, t) or nickname(t, s):
        return INITIAL
    if len(short) >= 3 and near(s, t):
        return SLIP
    return CUT if len(short) >= 3 and 2 * len(short) >= len(long) and abbreviates(short, long) else NONE


def aligned(a: str, b: str) -> str:
    """How two cores agree: `same`, `near` (one or two small slips), `close` (a slip in a token of three letters), `initial` (or a short given name or abbreviation), `part` (Chinese short form, or a token more), `prefixed` (Chinese place prefix), or ''.

    Tokens, however many, are assigned to each other at the least cost of slips, initials and abbreviations.
    """
    if a == b:
        return "same"
    if _CJK.search(a + b):
        if len(a) == len(b) >= 3 and near(a, b):
            return "near"
        short, long = sorted((a, b), key=len)
        if len(short) >= 3 and len(long) - len(short) == 1 and near(a, b):
            return "near"
        if len(short) >= 3 and long.endswith(short):
            return "prefixed"
        return "part" if 2 <= len(short) < len(long) and abbreviates(short, long) else ""
    x, y = sorted((a.split(), b.split()), key=len)
    if not x:
        return ""
    cost = [[token_cost(s, t) for t in y] for s in x]
    pairs = [(cost[i][j], min(len(x[i]), len(y[j]))) for i, j in enumerate(cheapest(cost))]
    if len(x) != len(y):
        if len(a) >= 8 and _joined(x, y):
            return "near"
        return "part" if len(x) >= 2 and len(y) - len(x) == 1 and all(c <= SLIP for c, _ in pairs) else ""
    if any(c >= NONE for c, _ in pairs):
        return ""
    slips, cuts = [n for c, n in pairs if c == SLIP], sum(c > SLIP for c, _ in pairs)
    if not cuts:
        return "close" if min(slips) < 4 else "near" if len(slips) <= (2 if len(x) > 1 else 1) else ""
    return "initial" if cuts == 1 and not slips and len(x) > 1 else ""


def first_letters(*names: str) -> list[str]:
    """The first letters of all words, sorted."""
    return sorted(w[0] for n in names for w in n.split())


def fits_initials(core: str, rest: str, core2: str, trade2: str) -> bool:
    """Whether a name of initials goes with another name: the letters left beside its core (`rest`) are those of the other's trade, or all its letters those of the other's core and trade; nothing left, or no trade, goes with all."""
    return not rest or not trade2 or sorted(rest) == first_letters(trade2) or sorted([*first_letters(core), *rest]) == first_letters(core2, trade2)
