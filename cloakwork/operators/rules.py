"""The built-in detection rules, and the store of custom ones."""

from __future__ import annotations

import json
import re
import secrets
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.checksums import valid_national_id, valid_tax_id
from ..functions.dialect import SPACE_CHARACTERS, to_java
from ..functions.spans import let

# ---- fixed values: the formats, labels and word lists that define the rules ----
HAN = "\\u4e00-\\u9fa5"
CITIES = (
    "(?:[臺台]北市|新北市|桃園市|[臺台]中市|[臺台]南市|高雄市|基隆市|新竹[市縣]|嘉義[市縣]|苗栗縣|彰化縣|南投縣|雲林縣|"
    "屏東縣|宜蘭縣|花蓮縣|[臺台]東縣|澎湖縣|金門縣|連江縣)"
)
COMPANY_ENDINGS = (
    "股份有限公司|有限公司|無限公司|兩合公司|企業社|工作室|事務所|商行|診所|基金會|協會|合作社|工程行|企業行|實業社|文化事業"
)
NOT_COMPANY = "的與和及於在由向從為對將把讓依據至到給經受同各該本貴我敝此其係即為者以並或如"
DOUBLE_SURNAMES = "歐陽|司馬|諸葛|上官|張簡|范姜|司徒|東方|令狐|南宮|端木|皇甫|尉遲|夏侯"
SURNAMES = (
    "陳林黃張李王吳劉蔡楊許鄭謝郭洪邱曾廖賴徐周葉蘇莊呂江何蕭羅高潘簡朱鍾游彭詹胡施沈余盧梁趙顏柯翁魏孫戴范方宋鄧杜傅侯曹薛丁卓阮馬董溫唐藍蔣石古紀姚連馮歐程湯田康姜白汪鄒尤巫鐘黎塗龔嚴韓袁金童陸夏柳邵錢伍倪甘秦官辛戚易祝樊喬向殷凌闕舒包鮑冉牛管毛涂"
)
AFTER_NAME = (
    "(?=$|[\\s\\d\\p{P}A-Za-z]|先生|小姐|女士|同學|醫師|醫生|護理師|老師|律師|經理|主任|董事|總監|組長|課長|科長|處長|局長|部長|教授|博士|君|兄|姐|哥|等|表示|說|指出|認為|於|在|與|和|及|為|所|之|的|已|將|曾|因|向|由|係|即|亦|並|或"
    "|另|也|則|更|未|不|有|無|是|非|對|從|自|以|被|經|卻|還|又|再|但|而|才|都|皆|均|便|就|會|能|可|應|須|要|想|願|正|到|來|去|至|提|收|付|持|稱|同意|聲明|陳述|申請|提供|前往|出席|簽|辦理|負責|擔任|購買|支付|領取|遞交|回覆|聯絡|通知|告知)"
)
NOT_IN_NAME = (
    "的了是在有和與及於為等所之已將因向由係即亦並或另也則未不無非對從自以被經卻還又再但而才都皆均便就會能可應須要想願到來去至收付持稱接提說表指認出簽辦負擔購支領遞回聯通告這那該此其每各們呢嗎吧啊麼什怎很太最曾先女士請讓使給把被令將於當若如則個"
)
#: Two-character words that start like a name. Only words with a surname's first character can ever be found, so only those are here.
NOT_NAMES = (
    "王國 王子 王牌 李子 張開 張貼 張力 陳述 陳列 陳舊 林口 林業 林地 高雄 高速 高中 高級 高度 高溫 高血 黃金 黃色 黃昏 吳郭 何時 何況 "
    "何人 何處 何等 何種 何者 何以 何不 何在 何其 何去 何謂 馬上 馬路 周年 周末 周邊 周圍 方法 方面 方向 方式 方案 許多 許可 江山 江湖 "
    "白色 白天 白血 金門 金額 金融 金屬 金錢 石頭 程式 程度 康復 施工 施行 羅列 夏天 夏季 田地 余額 毛病 古代 古蹟 紀錄 紀念 連結 連續 "
    "連接 連線 溫度 溫暖 唐朝 藍色 石油 康健 姜母 汪洋 童年 陸地 柳樹 錢包 甘心 秦朝 官方 官員 易於 祝福 喬木 向來 凌晨 舒服 包含 包括 "
    "包裝 鮑魚 牛肉 牛奶 管理 毛巾 柯南 翁婿 魏晉 孫子 戴上 范圍 宋朝 杜絕 侯爵 曹操 丁點 卓越 馬克 董事 藍圖 蔣公 石膏 鄧小 傅立 梁柱 "
    "趙錢 顏色 簡單 簡介 簡稱 朱紅 鍾情 游泳 游戲 詹姆 胡說 胡椒 沈默 盧比 呂宋 江西 何必 蕭條 羅馬 潘朵 莊園 蘇打 葉子 徐徐 廖化 賴床 "
    "曾經 洪水 郭台 謝謝 鄭重 許願 蔡英 劉海 吳哥 楊桃 張三 李四 王五 謝絕 謝意 許久 賴以 曾任 洪流 邱比 徐步 廖若 莊嚴 管轄 管制 管線 "
    "管道 管控 溫濕 溫馨 溫室 何疑 易雙 謝您 謝函 謝禮 高層 高額 方為 牛市 包商 向下 向上"
).split()
PARTY = r"[甲乙丙丁雙各買賣我他貴對本該多官軍校院廠資勞前後男女一二三四五六七八九十任另每]$"
NOT_HE = r"[任如為幾若奈無]$"
MRN_LABEL = r"(?:病歷(?:號|編號)|就診號|MRN|medical\s+record)\s*[:：#-]?\s*$"
BANK_LABEL = r"(?:銀行|匯款|收款|付款|帳號|賬號|account|acct)[^\n]{0,30}$"
CARD_LABEL = r"(?:信用卡|卡號|credit\s*card)[^\n]{0,20}$"
AMOUNT_LABEL = (
    r"(?:還款(?:金額|款項|總額)?|退款(?:金額|款項|總額)?|返還(?:金額|款項|總額)?|償還(?:金額|款項|總額)?|付款(?:金額|款項|總額)?|支付(?:金額|款項|總額)?|應(?:付|收)(?:金額|款項|總額)?"
    r"|限量\s*額度(?:為|是)?|上限\s*額度(?:為|是)?|額度\s*上限(?:為|是)?|CAP(?:\s*(?:金額|額度|上限))?|金額|款項|總額|總計|合計|小計|單價|報價|折扣|收入|營收|支出|費用|成本|預算|稅額|稅金|消費|營業額|回款|借款|貸款|本金|利息|餘額"
    r"|amount(?:\s+(?:due|paid|total))?|payment|repayment|refund|revenue|income|expense|cost|budget|price|total|subtotal|tax|balance|principal|interest)"
    r"[\s:：#-]*(?:NT\$|NTD|TWD|USD|EUR|JPY|CNY|RMB|新臺幣|新台幣|人民幣|美元|歐元|日圓|[\$＄¥￥])?[\s]*$"
)
#: Last characters, in small letters, of labels of amounts and of the currencies after them; and what may follow.
MRN_ENDS = "號nd"
AMOUNT_ENDS = "款額項還付收度為是限計價扣入出用本算金費息pedltx$＄¥￥bry幣元圓"
SEPARATORS = SPACE_CHARACTERS + ":：#-"
RATE_LABEL = r"(?:還款|退款|返還|償還|補償|扣除|折扣|回饋|申報(?:總)?金額|醫令申報金額|限量\s*額度|級距|比例|利率|rebate|repayment|refund|discount|rate)[^\n]{0,80}$"
DISTRICT, ROAD = f"(?:[{HAN}]{{1,4}}[鄉鎮市區])?", f"(?:[{HAN}\\d]{{1,8}}(?:路|街|大道))"
VILLAGE = f"(?:[{HAN}]{{1,4}}[村里])?(?:\\d{{1,3}}鄰)?"
HOUSE = (
    f"{VILLAGE}(?:[一二三四五六七八九十\\d]{{1,3}}段)?(?:\\d{{1,4}}巷)?(?:\\d{{1,4}}弄)?\\d{{1,5}}(?:之\\d{{1,3}})?號"
    f"(?:[\\d一二三四五六七八九十]{{1,3}}樓)?(?:之\\d{{1,3}})?(?:[{HAN}\\d]{{1,3}}室)?"
)
GROUPED = "(?:\\d{1,3}(?:\\s*[,，]\\s*\\d{3})+|\\d{1,12})"
UNITS = f"(?:{GROUPED}\\s*億(?:\\s*{GROUPED}\\s*萬)?\\s*元|{GROUPED}\\s*萬\\s*元)"
DECIMAL = "(?:\\d{1,3}(?:\\s*[,，]\\s*\\d{3})+|\\d{3,12}(?:\\s*\\.\\s*\\d{1,2})?|\\d{1,2}\\s*\\.\\s*\\d{1,2})"
NO_WORD_BEFORE, NO_WORD_AFTER = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"


def coded(words: str, tail: str) -> str:
    return f"{NO_WORD_BEFORE}(?:{words}){tail}{NO_WORD_AFTER}"


def digits(n: str) -> str:
    return rf"(?<![\d-])\d{{{n}}}(?![\d-])"


REGEXES = {
    "zh-name": f"(?:{DOUBLE_SURNAMES}|[{SURNAMES}])(?:[{HAN}]{{1,2}}{AFTER_NAME}|(?:(?![{NOT_IN_NAME}])[{HAN}]){{2}})",
    "tw-id": r"(?<![A-Za-z0-9])[A-Z][12]\d{8}(?!\d)",
    "tw-mobile": r"(?<![\d+])(?:\+886[-\x20]?9|09)\d{2}[-\x20]?\d{3}[-\x20]?\d{3}(?!\d)",
    "tw-landline": (
        r"(?<![\d(])(?:\(0(?:826|836|82|89|37|49|[2-8])\)[-\x20]?\d{3,4}[-\x20]?\d{3,4}|0(?:826|836|82|89|37|49|[2-8])[-\x20]\d{3,4}[-\x20]?\d{3,4}"
        r"|0[24]\d{8}|0[3-8]\d{7}|08[29]\d{6}|08[23]6\d{5})(?!\d)"
    ),
    "tw-address": f"(?:{CITIES}{DISTRICT}{VILLAGE}{ROAD}?|(?<![{HAN}]){DISTRICT}{ROAD}){HOUSE}",
    "tw-company": f"(?:(?![{NOT_COMPANY}])[{HAN}A-Za-z0-9&·]){{2,14}}?(?:{COMPANY_ENDINGS})",
    "tw-tax-id": digits("8"),
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "pharma-internal-id": coded("STAFF|CUST|VENDOR|SUPPLIER|FIN|DEPT|DOC", "[-_][A-Z0-9-]{2,20}"),
    "finance-bank-account": digits("10,16"),
    "finance-credit-card": r"(?<![\d])(?:\d{4}[- ]?){3}\d{4}(?![\d])",
    "finance-amount": rf"(?<![\d./-])(?:{UNITS}|{DECIMAL})(?![\d./-]|\s*%)",
    "finance-rate": r"(?<![\d.])\d{1,3}(?:\s*\.\s*\d{1,2})?\s*%(?!\d)",
    "finance-invoice": coded("[A-Z]{2}", r"\d{8}"),
    "finance-contract-code": coded("CON|CONTRACT|PO|PR|DOC|MEMO|SC", "[-_][A-Z0-9-]{3,24}"),
    "pharma-date": r"(?<![\d])(?:(?:19|20)\d{2}[-/.]\d{1,2}[-/.]\d{1,2}|民國\d{2,3}年\d{1,2}月\d{1,2}日)(?![\d])",
    "pharma-subject-id": f"(?<![A-Za-z0-9{HAN}])(?:SUBJ|SUBJECT|PT|PATIENT|CASE)[-_ ]?[A-Z0-9-]{{2,20}}{NO_WORD_AFTER}",
    "pharma-mrn": digits("6,12"),
    "pharma-trial-id": rf"{NO_WORD_BEFORE}(?:NCT\d{{8}}|(?:PROT|PROTOCOL|STUDY|TRIAL)[-_][A-Z0-9-]{{2,20}}){NO_WORD_AFTER}",
    "pharma-site": f"(?<![{HAN}A-Za-z0-9])[{HAN}A-Za-z0-9]{{2,20}}(?:醫學中心|醫院|研究中心|臨床試驗中心|診所)(?![{HAN}A-Za-z0-9])",
    "pharma-lot": coded("LOT|Lot|lot|BATCH|Batch|batch|批號|批次", "[-_:#： ]?[A-Z0-9][A-Z0-9-]{2,20}"),
    "pharma-product-code": coded("CMPD|COMPOUND|DRUG|API|ABX|RX|CP|DRG", "[-_][A-Z0-9-]{2,20}"),
}
CATEGORIES = dict(
    zip(
        REGEXES,
        "姓名 身分證 手機 市話 地址 公司 統編 電子郵件 識別碼 銀行帳號 信用卡 財務金額 財務比例 發票／單據號碼 合約／採購編號 日期 受試者編號 病歷號 試驗編號 研究中心 藥品批號 產品／化合物代碼".split(),
        strict=True,
    )
)
# ---- end of fixed values ----

Check = Callable[[Column, Column], Column]


def folded(text: Column) -> Column:
    """``text`` so that matching against small letters takes no account of case."""
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))


def labelled(pattern: str, ends: str | None = None) -> Check:
    """The text just before the match fits ``pattern``, upper or lower case.

    ``ends`` has the last characters of all that ``pattern`` fits, blanks and
    ``SEPARATORS`` after it left out; other texts are not searched.
    """
    java = re.sub(r"(?<!\\)[A-Z]", lambda m: m[0].lower(), to_java(pattern))

    def check(match: Column, before: Column) -> Column:
        if ends is None:
            return folded(before).rlike(java)

        def near(b: Column) -> Column:
            # one character is made small before the others are
            last = F.right(folded(F.right(F.rtrim(b, F.lit(SEPARATORS)), F.lit(1))), F.lit(1))
            return F.when(last.isin(*ends), folded(b).rlike(java)).otherwise(False)

        return let(before, near)

    return check


def plausible_name(match: Column, before: Column) -> Column:
    """Not a common word, a doubled character, a contract party or a question word."""
    return ~(
        F.substring(match, 1, 2).isin(NOT_NAMES)
        | match.rlike(r"\A(.)\1\z")
        | (match.startswith("方") & before.rlike(to_java(PARTY)))
        | (match.startswith("何") & before.rlike(to_java(NOT_HE)))
    )


CHECKS: dict[str, Check] = {
    "zh-name": plausible_name,
    "tw-id": lambda match, before: valid_national_id(match),
    "tw-tax-id": lambda match, before: valid_tax_id(match),
    "finance-bank-account": labelled(BANK_LABEL),
    "finance-credit-card": labelled(CARD_LABEL),
    "finance-amount": labelled(AMOUNT_LABEL, AMOUNT_ENDS),
    "finance-rate": labelled(RATE_LABEL),
    "pharma-mrn": labelled(MRN_LABEL, MRN_ENDS),
}


#: What every text with a match of a rule holds: a plain string, or a pattern that is found faster than the rule's own.
HINTS: dict[str, str | re.Pattern] = {
    "zh-name": re.compile(f"[{SURNAMES}{DOUBLE_SURNAMES.replace('|', '')}]"),
    "tw-address": "號",
    "tw-company": re.compile(f"[{''.join(dict.fromkeys(x[-1] for x in COMPANY_ENDINGS.split('|')))}]"),
    "email": "@",
    "pharma-internal-id": re.compile("[-_]"),
    "finance-rate": "%",
    "finance-contract-code": re.compile("[-_]"),
    "pharma-trial-id": re.compile("NCT|PROT|STUDY|TRIAL"),
    "pharma-site": re.compile("[院心所]"),
    "pharma-lot": re.compile("LOT|Lot|lot|BATCH|Batch|batch|批"),
    "pharma-product-code": re.compile("[-_]"),
    "pharma-subject-id": re.compile("SUBJ|PT|PATIENT|CASE"),
    **dict.fromkeys(("tw-id", "tw-mobile", "tw-landline", "tw-tax-id", "finance-bank-account", "finance-credit-card", "finance-amount", "finance-invoice", "pharma-date", "pharma-mrn"), re.compile("[0-9]")),
}


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    regex: str
    name: str = ""
    example: str = ""
    enabled: bool = True
    builtin: bool = False

    @property
    def java(self) -> str:
        return to_java(self.regex)

    @property
    def check(self) -> Check | None:
        return CHECKS.get(self.id) if self.builtin else None

    def hint(self, text: Column) -> Column | None:
        """False for texts in which the rule cannot match."""
        found = HINTS.get(self.id) if self.builtin else None
        return None if found is None else text.contains(found) if isinstance(found, str) else text.rlike(found.pattern)


BUILTIN = tuple(Rule(i, CATEGORIES[i], r, i, builtin=True) for i, r in REGEXES.items())


def _compiled(source: str):
    return SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(to_java(source))


def compiles(source: str) -> bool:
    try:
        _compiled(source)
    except (Py4JError, PySparkException):
        return False
    return True


def regex_error(source: str) -> str | None:
    """Why a custom pattern is refused, or None. It must compile and not match the empty text."""
    if not source.strip():
        return "規則不可為空"
    try:
        pattern = _compiled(source)
    except (Py4JError, PySparkException) as e:
        return f"無效的規則：{str(e).splitlines()[0]}"
    return "規則不可比對空字串" if pattern.matcher("").find() else None


@dataclass(frozen=True)
class RuleStore:
    """Version 1 of the configuration: switched-off built-ins, and custom rules in order."""

    disabled: tuple[str, ...] = ()
    custom: tuple[Rule, ...] = ()

    @classmethod
    def loads(cls, text: str | None) -> RuleStore:
        """Anything that is missing, broken or of another version gives the defaults; bad entries are left out."""
        try:
            data = json.loads(text or "null")
        except ValueError:
            return cls()
        if not isinstance(data, dict) or data.get("version") != 1:
            return cls()
        off = data.get("disabledBuiltins")
        own = data.get("customPatterns")
        rules = []
        for c in own if isinstance(own, list) else ():
            if isinstance(c, dict) and isinstance(c.get("regex"), str) and regex_error(c["regex"]) is None:
                rules.append(Rule(str(c.get("id")), str(c.get("category")), c["regex"], str(c.get("name", "")), str(c.get("example", "")), bool(c.get("enabled", True))))
        return cls(tuple(x for x in off if isinstance(x, str)) if isinstance(off, list) else (), tuple(rules))

    def dumps(self) -> str:
        keep = ("id", "name", "category", "regex", "example", "enabled")
        rows = [{k: asdict(r)[k] for k in keep} for r in self.custom]
        return json.dumps({"version": 1, "disabledBuiltins": list(self.disabled), "customPatterns": rows}, ensure_ascii=False)

    def effective(self) -> tuple[Rule, ...]:
        return tuple(replace(r, enabled=r.id not in self.disabled) for r in BUILTIN) + self.custom

    def with_builtin(self, rule_id: str, enabled: bool) -> RuleStore:
        rest = tuple(x for x in self.disabled if x != rule_id)
        return replace(self, disabled=rest if enabled else (*rest, rule_id))

    def with_custom(self, rule: Rule) -> RuleStore:
        if error := regex_error(rule.regex):
            raise ValueError(error)
        at = [r.id for r in self.custom]
        if rule.id in at:
            return replace(self, custom=tuple(rule if r.id == rule.id else r for r in self.custom))
        return replace(self, custom=(*self.custom, rule))

    def without_custom(self, rule_id: str) -> RuleStore:
        return replace(self, custom=tuple(r for r in self.custom if r.id != rule_id))


def new_custom_id() -> str:
    return "c-" + secrets.token_hex(3)


def is_marker_category(category: str) -> bool:
    """Whether markers of this category can be restored."""
    return re.fullmatch(r"[^\[\]:]{1,10}", category) is not None
