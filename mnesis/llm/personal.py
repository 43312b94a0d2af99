"""Personal information in free text: found, typed, and replaced by placeholders.

*Candidates.* Broad patterns propose spans of five types. *Labelers* vote on each (yes, no, abstain):
the strictness of the format, gazetteers and number plans, the context to the left and to the right,
the field it fills, links such as a surname that returns in an email address of the same text, and
usage: whether the corpus has a name's words in lower case too. *Aggregation.* Votes are counted by
pattern over all candidates of the whole table; expectation-maximisation over the pattern counts
estimates each labeler's reliability. *Classifier.* A logistic model over what no labeler sees
(neighbouring words, shapes, pieces of the words) is trained on a bounded sample (``TRAIN_ROWS``) of
candidates weighted by those estimates. Votes and classifier are two views of a candidate; the sum of
their log odds decides.

Scale. Three scans (words in lower case, candidates, and the placeholders of :func:`redact`) and no
shuffle of texts: candidates go to the shared folder; the counts of ``SLOTS`` words, the vote counts (at
most 3 ** 7 patterns a type) and the sample go to the driver, all bounded.

Edge cases. Null and blank texts hold nothing; rows without id give no rows. Very long texts are read
whole. Repeated rows count once. Overlapping spans: the likelier wins, then the earlier and longer.
An empty table gives an empty result; other columns are ignored by :func:`find_personal` and kept by
:func:`redact`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.workspace import materialize, spread

TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
LABELERS = ("format", "gazetteer", "left", "right", "field", "link", "usage")
#: Candidates on which the classifier is trained, at most, and its hashed features.
TRAIN_ROWS, FEATURES = 20_000, 1 << 14
#: Counters of the sketch of words in lower case, and how often a common word is met at least.
SLOTS, COMMON = 1 << 20, 3
#: Labelers whose abstention means nothing.
SILENT = (LABELERS.index("gazetteer"),)

#: Common given names of several countries that are no English or German words.
GIVEN_NAMES = frozenset(
    """
    aaron abdul abdullah abigail adam adela adele adrian adriana agata agnes agnieszka ahmad ahmed aiden aisha akiko akira alan
    albert alejandro aleksandr aleksandra alessandra alessandro alex alexander alexandra alexandre alexei alfonso alfred alfredo
    ali alice alicia alina alison allison alvaro amanda amara amelia amelie amina amir amy ana ananya anastasia anatoly anders
    andre andrea andreas andrei andrej andrew angela angelika angelo anil anita anja anke ann anna annabel anne annette annika
    anouk antoine anton antonia antonio arjun arne arnold arthur arturo ashley astrid aurelie axel ayse barbara barbora bart
    beata beatrice ben benedikt benjamin benoit bernadette bernard bernd bettina bianca birgit bjorn bogdan boris brandon brenda
    brian brigitte bruno bryan burak caleb camila camille carla carlo carlos carmen carol carolina caroline caterina catherine
    cecile cecilia celine cem chantal charles charlotte chen chiara chinedu chloe christa christian christiane christina
    christine christophe christopher claire clara claudia colin cornelia cristina cynthia dagmar damian damien daniel daniela
    danielle danuta dario david deborah deepak denis denise dennis derek diana diego dieter dietmar dimitri dirk dmitri dmitry
    dolores dominik donald donna dora doris dorothy douglas edith eduard eduardo edward eileen ekaterina elena eleni elias elif
    elisa elisabeth elisabetta elizabeth elke ella ellen eloise emanuele emeka emil emilia emilio emily emma emmanuel enrique
    enzo eric erica erik erika ernesto ernst esteban esther ethan etienne eugene eugenia eva evelyn evgeny fabian fabio fatima
    federico felicia felix ferdinand fernando filip fiona florian frances francesca francis francisco francois frank franz
    frederic frederik frieda friedrich gabriel gabriele gareth gary genevieve georg george gerald gerard gerhard gertrud
    gianluca gianni giovanni gisela giulia giuseppe gloria gonzalo gregor gregory greta gudrun guido guillaume guillermo gunter
    gunther gustav hamid hanna hannah hannes hans harald harold harriet hartmut hassan heather hector heidi heike heinrich heinz
    helen helena helene helga helmut hendrik henri henrik henry herbert hermann hideo hiroshi holger hortensia hubert hugo ian
    ibrahim ignacio igor ilse imran ines inga ingrid ioana irene irina isabel isabella ismail istvan ivan ivana ivo jacek jacob
    jacques jakob james jan jana jane janet janina janusz jared jaroslav jasmin jason javier jean jeffrey jennifer jens jeremy
    jerome jessica jessie jiri joan joanna joaquin jochen joel joern johan johanna johannes john jolanta jonas jonathan jorge
    jose josef josefine joseph joshua jozef juan judith julia julian juliane julien julio jun jurgen justin jutta kamal kamil
    karen karim karin karl karolina katarina katarzyna kate katharina katherine kathleen kathrin katja katrin keiko keith kelly
    kenji kenneth kevin khadija khalid kim kimberly kiran kirsten klara klaus kofi konrad kristina krzysztof kurt kyle lamar
    lara larissa larry lars laura laurent laurie lea leila lena leo leon leonie liam lidia lilian linda linnea lisa lorenzo
    lothar louis louisa louise luca lucas lucia lucie lucy ludwig luigi luis luisa lukas lutz lydia lydie madison magda
    magdalena mahmoud maike malgorzata malik manfred manuel marcel marcela marcelo marcin marco marcus marek margaret margarita
    margit margot maria mariam mariana marianne marie marina mario marion markus marlene marta martha martin martina mary mateo
    mathieu mathilde matteo matthew matthias maureen maurice maximilian megan mehmet mei melanie melissa mercedes mia michael
    michaela michal michel michele michelle miguel mikhail mila milan milena milos miriam mirko mohamed mohammad mohammed monika
    moritz muhammad murat mustafa nadia nadine nancy naomi natalia natalie natasha nathan nicholas nicole nigel nikita niklas
    nikolai nikos nils nina nkechi noah noor nora norbert odile olaf oleg olena olga oliver olivia olivier oluwaseun omar oscar
    oskar otto owen pablo pamela pascal patrice patricia patrick paul paula pauline pavel pawel pedro penelope pete peter petra
    philip philipp philippe pierre pilar piotr pradeep priya rachel rafael rahul raimund rainer rajesh rajiv ralf ralph ramon
    ramona rana raphael raquel rasmus raul ravi raymond rebecca regina reinhard reinhold renate renee ricardo riccardo richard
    rita robert roberto roger rohan roland rolf romain roman ronald rosa rosalind rosario rosemary roxana rudolf rupert ruth
    ryan sabine sabrina salma salvatore samantha samir samuel sandra sanjay santiago sara sarah satoshi sebastian selma sergei
    sergey sergio sharon shirley siegfried sigrid silke silvia simon simona simone sina sinead siobhan snezana sofia solveig
    sonja sophia sophie soren stacy stanislav stefan stefania stefanie stefano stephan stephanie stephen steve steven stuart
    sunita susan susanne suzanne sven svetlana sylvia sylvie tadeusz takeshi tamara tanja tanya tara tariq tatiana tatjana
    terence teresa thabo thea theodor theresa thierry thomas thorsten tiago tilda till tim timo timothy tina tobias todd tom
    tomas tomasz tony torsten tracy ulla ulrich ulrike ursula uta uwe valentina valerie vanessa vasily vera veronica victor
    victoria vikram viktor viktoria vincent vincenzo viola virginia vivek vivian vladimir volker walter wanda wei wendy wenzel
    werner wilhelm william winfried wojciech wolfgang xavier xiao yannick yara yasin yasmin yasmine yevgeny yolanda yolande yuki
    yuri yusuf yves yvonne zainab zbigniew zeynep zoe zofia zoya zsolt
    """.split()
)
#: Chinese compound surnames.
COMPOUND_SURNAMES = "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 闾丘 子车 亓官 司寇 巫马 公西 颛孙 壤驷 公良 漆雕 乐正 宰父 谷梁 拓跋 夹谷 轩辕 令狐 段干 百里 呼延 东郭 南门 羊舌 微生 公户 公玉 公仪 梁丘 公仲 公上 公门 公山 公坚 左丘 公伯 西门 公祖 第五 公乘 贯丘 公皙 南荣 东里 东宫 仲长 子书 子桑 即墨 淳于 达奚 褚师 吴铭".split()

#: The most frequent Chinese surnames of one character.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"

_AT = r"(?:\s?[@＠﹫]\s?|\s*[\[({<]\s*(?:at|AT|At)\s*[\])}>]\s*|\s+(?:at|AT|At)\s+|_at_)"
_DOT = r"(?:[.．。](?=[A-Za-z0-9])|\s*[\[({<]\s*(?:dot|DOT|Dot)\s*[\])}>]\s*|\s+(?:dot|DOT|Dot)\s+)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+\-@/])(?P<local>[A-Za-z0-9][A-Za-z0-9._%+\-']*(?:(?:\s*[\[({{]\s*(?:dot|DOT)\s*[\])}}]\s*|\s+DOT\s+)[A-Za-z0-9_+\-]+)*)(?P<at>{_AT})(?P<domain>{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}})(?![A-Za-z0-9])"
)
PHONE = re.compile(r"(?<![A-Za-z0-9_.@/#+(\-])(?<!\d )(?:\+\(?|\()?\d(?:[\d ().\-/]{5,22})\d(?![A-Za-z0-9_@]|[.\-/]\d)")
_PLANS = [
    re.compile(p)
    for p in (
        r"(?:\+?1[ .\-]?)?(?:\([2-9]\d\d\)[ .\-]?|[2-9]\d\d[ .\-]?)[2-9]\d\d[ .\-]?\d{4}$",
        r"(?:\+|00)[1-9]\d{0,2}[ .\-/]?(?:\(0?\d{0,4}\)[ .\-/]?)?\d[\d .\-/]{4,14}\d$",
        r"\(?0[1-9]\d{1,4}\)?[ ./\-]\d[\d .\-/]{4,10}\d$",
        r"1\d{2}[ \-]?\d{4}[ \-]?\d{4}$",
    )
]
SSN = re.compile(r"(?<![\w.\-/])(?<!\d )\d{3}([-. /])\d{2}\1\d{4}(?![\w\-/]|\.\d| \d)")
NINE = re.compile(r"(?<![\w.\-/+@:])\d{9}(?![\w\-/]|\.\d)")
NINO = re.compile(r"(?<![\w\-])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)|(?<![\w\-])QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)", re.I)
PASSPORT = re.compile(r"(?<![\w\-])[A-Z]{1,2}\d{7,8}(?!\w)", re.I)
CARD = re.compile(r"(?<![\w\-])(?=[A-Z0-9]{9}\d?[A-Z]?(?!\w))(?=[A-Z0-9]*\d)[CFGHJKLMNPRTVWXYZ][A-Z0-9]{8}\d?[A-Z]?(?!\w)", re.I)
CITIZEN = re.compile(r"(?<!\d)\d{17}[\dXx](?!\w)")
TAX_ID = re.compile(r"(?<![\w.\-/+])\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{3}(?!\w)|(?<![\w.\-/+])\d{2,3}/\d{3}/\d{4,5}(?!\w)|(?<![\w.\-/+])\d{2}-\d{7}(?!\w)")
_STREET = r"(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|boulevard|blvd|terrace|ter|way|place|pl|square|sq|close|crescent|parkway|pkwy|highway|alley|circle|row)"
_HOUSE = r"(?:no\.?\s*)?\d{1,5}\s?[a-z]?"
_UNIT = r"(?:(?:apt|apartment|unit|flat|suite|ste|room|#)\.?\s*\d+\s?[a-z]?,?\s+)"
ADDRESS = re.compile(rf"(?<![\w.\-/@#])(?:{_UNIT}?{_HOUSE}\s+(?:[^\W\d_][\w'’\-]*\s+){{1,4}}?{_STREET}\b\.?|{_UNIT}?{_HOUSE},?\s+(?:rue|avenue|boulevard|place|chemin|impasse|allée|via|calle)\s+(?:(?:de|du|des|la|le|l'|d'|della|del)\s*)*[^\W\d_][\w\-]*)", re.I)
_WAY = r"(?:rue|avenue|avenida|boulevard|place|plaza|piazza|chemin|impasse|allée|via|viale|calle|rua|paseo|paseig)"
FOREIGN = re.compile(rf"\b{_WAY}\s", re.I)
#: The house after the street, as in Spanish, Portuguese and Italian.
AVENIDA = re.compile(rf"(?<![\w.\-/])(?:avenida|calle|rua|via|viale|piazza|plaza|paseo|corso)\s+(?:(?:de|del|della|di|da|do|dos|das|la|los|las)\s+)*[A-ZÀ-Þ][\w'’\-]*(?:\s+(?:(?:de|del|da|do|di)\s+)?[A-ZÀ-Þ][\w'’\-]*){{0,2}},?\s+(?:n[.º°]?\s*)?\d{{1,5}}(?![\w\-])", re.I)
BOX = re.compile(r"(?<![\w.])(?:p\.?\s?o\.?\s?box|post office box|postfach)\s*\d+", re.I)
STRASSE = re.compile(r"(?<![\w.\-/])(?:(?:Am|An der|An den|Im|In der|Auf dem|Zum|Zur|Unter den|AM|am)\s+)?[A-ZÄÖÜa-zäöü][\w\-]*(?:straße|strasse|str\.|platz|weg|allee|gasse|ring|ufer|damm|STRASSE|PLATZ|WEG)\s+\d{1,4}\s?[a-z]?(?![\w\-])")
HAUS = re.compile(r"(?:住在|寄到|送到|住址是?|地址是?|位于|搬到|家在)?[:：]?((?:[一-鿿]{2,3}省)?(?:[一-鿿]{2,3}市)?(?:[一-鿿]{1,3}区)?[一-鿿]{1,5}?(?:路|街|大道|巷|弄|胡同)\d{1,5}号)")
_CAP = r"[A-ZÀ-Þ][^\W\d_]+(?:['’\-][A-ZÀ-Þ]?[^\W\d_]+)*"
_INITIALS = r"(?:[A-ZÀ-Þ]\.[ ]?){1,3}"
NAME = re.compile(rf"(?<![\w.@/\-])(?P<given>[^\W\d_]{{2,}}(?:-[^\W\d_]{{2,}})*)\s+(?:{_INITIALS}\s*)?(?P<family>[^\W\d_][^\W\d_]+(?:['’\-][^\W\d_]+)*)(?![\w@/]|[._\-]\w|\s?[＠@])")
#: The same where both words are capitalised, for texts without a given name of the list.
_UPPER = "[A-ZÀ-ÖØ-ÞĀ-žА-ЯЁΑ-Ω]"
NAME_CAPS = re.compile(rf"(?<![\w.@/\-])(?P<given>{_UPPER}[^\W\d_]+(?:-[^\W\d_]{{2,}})*)\s+(?:{_INITIALS}\s*)?(?P<family>{_UPPER}[^\W\d_]+(?:['’\-][^\W\d_]+)*)(?![\w@/]|[._\-]\w|\s?[＠@])")
_LETTERS = re.compile(r"[^\W\d_]+")
INITIALS = re.compile(rf"(?<![\w.@/\-]){_INITIALS}\s*(?P<family>{_CAP})(?![\w@/]|[._]\w)")
REVERSED = re.compile(rf"(?<![\w.@/\-])(?P<family>{_CAP}),\s?(?P<given>(?:{_CAP}|{_INITIALS}))(?![\w@/]|[_\-]\w|\.\w{{2,}})")
HAN_NAME = re.compile(rf"(?:{'|'.join(COMPOUND_SURNAMES)})[一-鿿]{{1,2}}")
#: A surname of one character starts many words, so only where a person is announced or addressed.
HAN_SHORT = re.compile(rf"(?:(?<=联系人)|(?<=负责人)|(?<=收件人)|(?<=经办人)|(?<=审核人)|(?<=请找)|(?<=姓名)|(?<=作者)|(?<=我叫)|(?<=名叫))[是为叫：:]?(?P<name>[{SURNAMES}][一-鿿]{{1,2}})(?![一-鿿])|(?P<called>[{SURNAMES}][一-鿿]{{1,2}}?)(?=先生|女士|小姐|博士)")
#: Words that follow a person who does something, and characters that don't stand in a given name.
_HAN_ACTS = "昨天|今天|明天|上周|下周|已经|刚刚|正在|提交|修复|负责|说|问|写|回复|认为|建议|同意|提出|表示|告诉|发现|完成|合并|审核"
_HAN_PLAIN = "的之是了在和与章节年月日号个们这那有不也就都很到上下多少一二三四五六七八九十末天前后里中间时候额次条点分并且或请把被将从向给"
HAN_ACTOR = re.compile(rf"(?:(?<![一-鿿])|(?<=[由和跟与请让给找]))(?P<name>[{SURNAMES}][^\W\da-zA-Z_{_HAN_PLAIN}]{{1,2}}?)(?={_HAN_ACTS})")
_HAN_FUNCTION = re.compile(f"[{_HAN_PLAIN}]")
HAN_ANY = re.compile(r"(?<=联系人是|负责人：|负责人:|负责人是|联系人：)[一-鿿]{2,4}(?![一-鿿])|(?<=请找)[一-鿿]{2,4}(?![一-鿿])")

#: What an address that counts has: a sign, a bracketed or capital "at", or a spelled-out dot.
_AT_SIGN = re.compile(r"[@＠﹫]|[\[({<]\s*(?:at|AT|At)\s*[\])}>]|\bAT\b|_at_|\b(?:dot|DOT|Dot)\b")
_DIGIT = re.compile(r"\d")
_HAN_CUED = re.compile("先生|女士|小姐|博士|联系人|负责人|收件人|经办人|审核人|请找|姓名|作者|我叫|名叫")
#: What announces an identifier; a text without any of these holds no cued one.
_ID_CUE = r"ssn|social|tin|tax\w*|insurance|nino|ni number|national\w*|passport|passnummer|reisepass|document|ausweis\w*|personalausweis|identity|identity card|id card|id number|steuer\w*|sozialversicherung\w*|identification|身份证\w*|护照\w*|证件\w*|税号"
_ID_WORD = re.compile(_ID_CUE)
_PHONE_LEFT = re.compile(r"(?:phone|tel|mobile|cell|call|text|ring|fax|number|contact|reach|dial|left|whatsapp|handy|telefon|mobil|anrufen|unter|nummer|电话|手机|打|致电|号码)(?:\W*(?:no|nr|is|at|on|number|unter|是)?)?\W*$", re.I)
_PHONE_NOT = re.compile(r"(?:build|offset|timestamp|size|port|ticket|commit|trace|version|page|bytes|failed|error|code|line|row|entry|pid|serial|order|invoice|listens on)\W*$", re.I)
_AFTER_NOT = re.compile(r"\s*(?:bytes|ms|items|rows|entries|sec|seconds|times|failed|percent|%|tokens|lines|KB|MB|GB)\b", re.I)
_ID_LEFT = re.compile(rf"(?:{_ID_CUE})(?:[\s\w]{{0,12}}?(?:number|no|nr|id|num|号码|号|code)?\.?)?(?:\s+is|\s+ist|是|为)?\W*$", re.I)
_ID_NOT = re.compile(r"(?:build|offset|timestamp|ticket|commit|trace|version|serial|order|invoice|sku|model|part)\W*$", re.I)
_HOME_LEFT = re.compile(r"(?:lives at|live at|visit|addr\w*|ship\w* (?:it )?to|ship_to|sent? to|goes to|deliver\w* to|street|from|wohnt in|anschrift|adresse|lieferung an|住在|寄到|送到|地址\w*)\W*$", re.I)
_NAME_LEFT = re.compile(r"(?:contact is|ask|cc|signed by|thank|met|reported by|spoke to|call with|according to|from|with|by|and|reviewer|owner|author|name|assignee|mr\.?|ms\.?|mrs\.?|miss|dr\.?|prof\.?|herrn?|frau|gemeldet von|bitte an|ansprechpartner(?:in)? ist|mail an|联系人是|负责人|请找)\W*$", re.I)
_NAME_RIGHT = re.compile(r"(?:,?\s*(?:who|she said|he said|they said)\b|\s+(?:asked|said|wrote|called|reviewed|replied|agreed|thinks|suggested|joined|fixed|reported|noticed)\b|\s*\(?\s*[\w.+\-]+\s?@)", re.I)
_NAME_NOT = re.compile(r"\s+(?:bridge|street|lane|avenue|road|release|module|drive|court|terrace|blvd|hotfix|project|server|branch|cluster)\b", re.I)
_FIELD = re.compile(r"(?:^|[\n|/]\s*|--\s*|[\w\"']\s*[:=]\s*[\"']?|[<(]\s*)$")
_CLOSE = re.compile(r"[\"'>)]?\s*(?:$|[\n|;,.。；，}])")
_HAN_LEFT = re.compile(r"(?:联系人|负责人|请找|找|是|：|:|由)\s*$")


class Candidate(NamedTuple):
    type: int
    start: int
    end: int
    votes: tuple[int, ...]


def _vote(yes: object, no: object = False) -> int:
    return -1 if no else 1 if yes else 0


def _digits(s: str) -> str:
    return "".join(filter(str.isdigit, s))


def _valid_citizen(d: str) -> bool:
    return "18" <= d[6:8] <= "20" and "01" <= d[10:12] <= "12" and "01" <= d[12:14] <= "31"


def candidates(text: str, common: np.ndarray | None = None) -> list[Candidate]:
    """All spans that could be personal information, with the labelers' votes. ``common`` marks the slots
    of words that the corpus uses in lower case; without it, that labeler abstains."""
    out: list[Candidate] = []
    locals_: set[str] = set()
    low = text.lower()

    def add(kind: int, start: int, end: int, form: int, gazetteer: int, left: int, right: int, link: int = 0, usage: int = 0) -> None:
        before, after = text[max(0, start - 40) : start], text[end : end + 3]
        out.append(Candidate(kind, start, end, (form, gazetteer, left, right, _vote(_FIELD.search(before) and _CLOSE.match(after)), link, usage)))

    if _AT_SIGN.search(text):
        for m in EMAIL.finditer(text):
            at, domain, start = m["at"], m["domain"], m.start()
            spelled = not any(c in at for c in "@＠﹫")
            if spelled and at.strip().isalpha() and not re.search(r"\s(?:dot|DOT|Dot)\s|[\[({<]\s*dot", domain) and at.strip() != "AT":
                continue  # "at foo.py" in a sentence
            if spelled and at.strip() == "AT" and "DOT" not in domain and "." not in domain:
                continue
            tail = text[m.end() : m.end() + 2]
            machine = tail[:1] == ":" and tail[1:2] not in ("", " ", "\n") or m["local"].lower() in ("git", "deploy", "root", "admin", "ssh")
            locals_.update(p for p in re.split(r"[^a-z]+", m["local"].lower()) if len(p) > 3)
            before = low[max(0, start - 30) : start]
            cue = re.search(r"(?:mail|e-mail|email|login|write to|report to|reachable under|mailto|邮箱|邮件发到|an)\W*$", before)
            not_cue = re.search(r"(?:remote is|pinned|prompt showed|package|clone)\W*$", before)
            tld = re.split(r"[^a-z]+", domain.lower())[-1]
            add(0, start, m.end(), _vote(not machine, machine), _vote(len(tld) >= 2, tld in _CODE_ENDS), _vote(cue, not_cue), _vote(False, machine and tail[:1] == ":"))
    taken = [(c.start, c.end) for c in out]

    def free(start: int, end: int) -> bool:
        return all(end <= a or b <= start for a, b in taken)

    ids: list[tuple[int, int, int, int]] = []  # start, end, strictness, validity
    numbers = bool(_DIGIT.search(text))
    if numbers:
        for m in CITIZEN.finditer(text):
            ids.append((m.start(), m.end(), 1, _vote(_valid_citizen(m[0]), not _valid_citizen(m[0]))))
        ids += [(m.start(), m.end(), 1, 1) for m in SSN.finditer(text)]
        ids += [(m.start(), m.end(), 1, 1) for m in NINO.finditer(text)]
        ids += [(m.start(), m.end(), 0, 0) for p in (PASSPORT, CARD) for m in p.finditer(text)]
        if _ID_WORD.search(low.replace("ſ", "s").replace("ı", "i")):  # as re.I takes them
            ids += [(m.start(), m.end(), -1, 0) for p in (NINE, TAX_ID) for m in p.finditer(text)]
        seen: set[tuple[int, int]] = set()
        for a, b, form, valid in ids:
            if (a, b) in seen or not free(a, b):
                continue
            seen.add((a, b))
            before = low[max(0, a - 40) : a]
            cue, not_cue = _ID_LEFT.search(before), _ID_NOT.search(before)
            if form < 0 and not cue or form == 0 and not cue and not (text[a].isupper() and _FIELD.search(before)):
                continue
            add(2, a, b, max(form, 0), valid, _vote(cue, not_cue), _vote(False, _AFTER_NOT.match(text[b : b + 12])))
        strict = [(a, b) for a, b, form, _ in ids if form > 0]
        for m in PHONE.finditer(text):
            a, b, s = m.start(), m.end(), m[0]
            if s.count("(") != s.count(")"):
                if s[0] == "(" and ")" not in s:
                    a, s = a + 1, s[1:]
                elif ")" in s and "(" not in s:
                    b = a + s.index(")")
                    s = text[a:b]
            n = len(_digits(s))
            if not 7 <= n <= 15 or not free(a, b) or any(x < b and a < y for x, y in strict):
                continue
            before, after = low[max(0, a - 40) : a], text[b : b + 14]
            plan = any(p.match(s) for p in _PLANS)
            cue, not_cue = _PHONE_LEFT.search(before), _PHONE_NOT.search(before)
            if not plan and not cue:
                continue
            known = s[0] == "+" or s[:2] == "00" or "(" in s or s[0] == "0"
            bare = s.isdigit() and not known
            id_cue = _ID_LEFT.search(before) and not cue
            add(1, a, b, _vote(plan and not bare, not plan), _vote(known or re.search(r"555[ .\-]?01\d\d$", s) or (cue and _PLANS[3].match(s))), _vote(cue, not_cue or id_cue), _vote(re.match(r"\s*(?:ext|x|durchwahl|分机)\b", after, re.I), _AFTER_NOT.match(after)))

    for pattern in (ADDRESS, BOX, STRASSE, AVENIDA) if numbers else ():
        for m in pattern.finditer(text):
            a, b = m.start(), m.end()
            if not free(a, b):
                continue
            before = low[max(0, a - 40) : a]
            inner = [w[0].isupper() for w in re.findall(r"\b[^\W\d_]{2,}", m[0])]
            foreign = FOREIGN.search(m[0])
            if pattern is AVENIDA and not m[0].split()[-2][0].isupper() and not re.search(r"\s[A-ZÀ-Þ]", m[0]):
                continue  # "via 12 hops"
            if pattern is ADDRESS and not foreign and len(set(inner)) > 1:
                continue  # part of a sentence
            plain = pattern is ADDRESS and not any(inner) and not foreign
            cue = _HOME_LEFT.search(before)
            if plain and not cue and not (_FIELD.search(before) and _CLOSE.match(text[b : b + 3])):
                continue
            add(3, a, b, _vote(not plain), _vote(pattern is not ADDRESS or re.match(r"[^\n]*?(?:,\s*[A-ZÀ-Þ]|,\s*(?:unit|apt)|\s+\d{5}|\.?$|\.\s)", text[b : b + 30])), _vote(cue), _vote(re.match(r"\s*,\s*(?:\d{4,6}\s+)?[A-ZÀ-Þ]", text[b : b + 12]), re.match(r"\s+(?:bridge|module)\b", text[b : b + 10], re.I)))
    if not text.isascii():
        for m in HAUS.finditer(text) if "号" in text else ():
            a, b = m.start(1), m.end(1)
            add(3, a, b, 1, _vote("市" in m[1]), _vote(a > m.start(), False), 0)
        for pattern in (HAN_NAME, HAN_SHORT, HAN_ACTOR, HAN_ANY) if _HAN_CUED.search(text) else (HAN_NAME, HAN_ACTOR):
            for m in pattern.finditer(text):
                a, b = m.span(m.lastgroup or 0)
                cue = _HAN_LEFT.search(text[max(0, a - 4) : a]) or pattern is HAN_SHORT
                if any(c.type == 4 and c.start <= a < c.end for c in out):
                    continue
                if pattern is HAN_SHORT:
                    add(4, a, b, 1, 1, 1, 1)
                    continue
                if pattern is HAN_ACTOR:
                    add(4, a, b, 1, 0, _vote(cue), 1)
                    continue
                if pattern is HAN_NAME and _HAN_FUNCTION.search(text[a + 2 : b]):  # a compound surname's characters in ordinary words
                    add(4, a, b, -1, -1, _vote(cue, not cue), -1)
                    continue
                add(4, a, b, _vote(cue and not re.match(r"[一-鿿]", text[b : b + 1])), _vote(pattern is HAN_NAME), _vote(cue), _vote(not re.match(r"[一-鿿]", text[b : b + 1])))

    listed = not GIVEN_NAMES.isdisjoint(_LETTERS.findall(low))
    for pattern in (NAME if listed else NAME_CAPS, INITIALS, REVERSED):
        at = 0
        while m := pattern.search(text, at):
            at = m.start() + 1
            a, b = m.start(), m.end()
            groups = m.groupdict()
            given, family = groups.get("given"), groups["family"]
            known = bool(given) and given.lower().split("-")[0] in GIVEN_NAMES
            if pattern in (NAME, NAME_CAPS) and not known and not (given[0].isupper() and family[0].isupper()):
                continue
            before, after = text[max(0, a - 40) : a], text[b : b + 24]
            cue = _NAME_LEFT.search(before)
            linked = any(family.lower().split("-")[0] in x or x in family.lower() for x in locals_) if locals_ and len(family) > 3 else False
            shape = family[0].isupper() and (given is None or given[0].isupper())
            if pattern in (NAME, NAME_CAPS) and known and not shape and not cue and not (_FIELD.search(before) and _CLOSE.match(text[b : b + 3])):
                continue
            if family.lower() in _NOT_FAMILY or given and _ID_WORD.fullmatch(given.lower()):
                continue
            unknown = pattern is not INITIALS and not known and not re.fullmatch(_INITIALS, given)
            if unknown and (given.lower() in _NOT_GIVEN or pattern is REVERSED and given.lower() in _NOT_FAMILY):
                continue
            if unknown and not cue and (given.isupper() or family.isupper()):
                continue  # a text in capitals
            if pattern is INITIALS and re.match(r"P\.\s?O\.", m[0]) or family.lower() == "box" or not free(a, b):
                continue
            if pattern in (NAME, NAME_CAPS) and not unknown:  # the next match may start after this name only
                at = b
            usage = 0
            if unknown and common is not None:
                plain = [bool(common[slot(w.lower())]) for w in re.split(r"[\s\-'’]+", f"{given} {family}") if len(w) > 1]
                usage = _vote(not any(plain), any(plain))
            add(4, a, b, _vote(shape, not shape and not cue), _vote(known or pattern is INITIALS), _vote(cue), _vote(_NAME_RIGHT.match(after), _NAME_NOT.match(after) or re.search(r"\b(?:The|the|our|a|an)\s+$", before)), _vote(linked), usage)
    return out


#: Words that open a sentence or end a file name, not a name.
_NOT_GIVEN = frozenset("the a an this that these those there when then later since even for from in on at by to with most once under according as and or but if one some each it we they our their nobody after before between what where who why how which with der die das wir wenn nach es im update monday tuesday wednesday thursday friday saturday sunday january february april june july august september october november december frau herr herrn mr mrs ms miss dr prof ask".split())
_NOT_FAMILY = _NOT_GIVEN | frozenset("said asked is was were are has had who which owns und oder von asked about she he nr no".split())
_CODE_ENDS = frozenset("py js ts json yml yaml md txt cfg ini toml lock sh".split())


def slot(word: str) -> int:
    """The counter of a word, as ``pmod(xxhash64(word), SLOTS)`` has it."""
    return xxhash.xxh64_intdigest(word, 42) % SLOTS


def common_words(items: DataFrame) -> np.ndarray:
    """Which slots hold words that the texts use in lower case, from counts over all of them.

    Partial counts by slot; at most ``SLOTS`` of them reach the driver. A slot is common from ``COMMON``
    uses, and four times the average, on.
    """
    found = items.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_.@/-])(\p{Ll}{2,})(?![\p{L}\p{N}_@])"), 1)).alias("w"))
    counts = found.groupBy(F.pmod(F.xxhash64("w"), F.lit(SLOTS)).alias("slot")).agg(F.count("*").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[counts["slot"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    return out >= max(COMMON, 4 * out.sum() / SLOTS)


def features(text: str, c: Candidate) -> list[int]:
    """The number of a candidate's votes, then its hashed features that no labeler sees: neighbouring
    words, shapes, and pieces of its words, by type."""
    left = re.findall(r"\w+|[^\w\s]", text[max(0, c.start - 24) : c.start].lower())[-2:]
    right = re.findall(r"\w+|[^\w\s]", text[c.end : c.end + 16].lower())[:1]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"\d", "9", text[c.start : c.end]))))[:24]
    names = [f"l={w}" for w in left[-1:]] + [f"ll={' '.join(left)}"] + [f"r={w}" for w in right] + [f"s={shape}", "bias"]
    names += [f"rr={' '.join(re.findall(r'[^\W_]+|[^\w\s]', text[c.end : c.end + 24].lower())[:2])}"]
    if c.type == 4:
        words = re.findall(r"[^\W\d_]+", text[c.start : c.end].lower())
        names += [f"e={w[-3:]}" for w in words] + [f"b={w[:2]}" for w in words[:1]] + [f"n={len(words)}"]
    return [_pattern(c.type, c.votes)] + [xxhash.xxh32_intdigest(f"{c.type}|{n}") % FEATURES for n in names]


def _pattern(kind: int, votes: tuple[int, ...]) -> int:
    """Type and votes as one number."""
    return kind * 3 ** len(LABELERS) + sum((v + 1) * 3**i for i, v in enumerate(votes))


def aggregate_votes(counts: dict[tuple[int, ...], float], rounds: int = 60, silent: tuple[int, ...] = ()) -> dict[tuple[int, ...], float]:
    """Probability that a candidate with each pattern of votes is true, by expectation-maximisation.

    Two classes; each labeler votes -1, 0 or 1 with class-wise rates. Rates start from, and are pulled
    towards, a labeler that is right three times in four, so the classes can't swap. An abstention tells
    something too, but for the ``silent`` labelers: not to be in a list of names means nothing.
    """
    patterns = np.array(list(counts), dtype=int) + 1
    n = np.array(list(counts.values()), dtype=float)
    k = patterns.shape[1]
    prior = np.array([[0.45, 0.35, 0.20], [0.08, 0.37, 0.55]])  # of votes -1, 0, 1 in a false, a true case
    rates, share = np.repeat(prior[:, None], k, axis=1), 0.7
    strength = 0.02 * n.sum() + 5
    for _ in range(rounds):
        weight = np.log(rates)
        weight[:, list(silent), 1] = 0.0
        like = np.log(np.array([1 - share, share]))[:, None] + sum(weight[:, j][:, patterns[:, j]] for j in range(k))
        p = 1 / (1 + np.exp(np.clip(like[0] - like[1], -60, 60)))
        for y, w in ((0, n * (1 - p)), (1, n * p)):
            for j in range(k):
                seen = np.bincount(patterns[:, j], w, 3) + strength * prior[y]
                rates[y, j] = seen / seen.sum()
        share = float(np.clip(((n * p).sum() + 0.7 * strength) / (n.sum() + strength), 0.05, 0.98))
    return {tuple(x): float(q) for x, q in zip(map(tuple, (patterns - 1).tolist()), p)}


class SpanClassifier:
    """A logistic model over hashed features."""

    def __init__(self, rows: list[list[int]], target: np.ndarray, rounds: int = 120, rate: float = 0.5, ridge: float = 1e-4):
        self.weights = np.zeros(FEATURES)
        if not rows:
            return
        flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        past = np.full(FEATURES, 1e-8)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, self.weights[flat], len(rows)), -40, 40)))
            grad = np.bincount(flat, (p - target)[owner], FEATURES) / len(rows) + ridge * self.weights
            past += grad**2
            self.weights -= rate * grad / np.sqrt(past)

    def logit(self, row: list[int]) -> float:
        return float(np.clip(self.weights[row].sum(), -40, 40))

    def probability(self, row: list[int]) -> float:
        return _sigmoid(self.logit(row))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x))


class SpanModel:
    """Both views of a candidate: what the votes say (the estimates of expectation-maximisation, kept
    within ``trust`` either way) and what the classifier makes of words and shapes around and in it.

    ``view`` weighs the classifier against the votes.
    """

    def __init__(self, truth: dict[int, float], classifier: SpanClassifier, common: np.ndarray | None, trust: float = 4.0, view: float = 0.5):
        self.truth, self.classifier, self.common, self.trust, self.view = truth, classifier, common, trust, view

    def voted(self, pattern: int) -> float:
        """The probability by the votes alone; of a pattern that was never met, by their balance."""
        if pattern in self.truth:
            return self.truth[pattern]
        return _sigmoid(1.5 * sum(pattern // 3**i % 3 - 1 for i in range(len(LABELERS))))

    def probability(self, row: list[int]) -> float:
        p = min(max(self.voted(int(row[0])), 1e-9), 1 - 1e-9)
        votes = min(max(math.log(p / (1 - p)), -self.trust), self.trust)
        return _sigmoid(votes + self.view * self.classifier.logit(row[1:]))

    def find(self, text: str) -> list[tuple[Candidate, float]]:
        own = candidates(text, self.common)
        return choose(own, [self.probability(features(text, c)) for c in own])


def choose(found: list[Candidate], p: list[float], least: float = 0.5) -> list[tuple[Candidate, float]]:
    """Spans likely enough that don't overlap: the likelier first, then the earlier and longer."""
    out: list[tuple[Candidate, float]] = []
    for c, q in sorted(zip(found, p), key=lambda x: (-round(x[1], 1), x[0].type == 4, x[0].start, -x[0].end)):
        if q >= least and all(c.end <= o.start or o.end <= c.start for o, _ in out):
            out.append((c, q))
    return sorted(out, key=lambda x: x[0].start)


CANDIDATES = "id string, type array<int>, start array<int>, end array<int>, votes array<string>, features array<array<int>>"
FOUND = "id string, pii_type string, start_pos bigint, end_pos bigint, probability double"


def _candidate_table(items: DataFrame, common: np.ndarray | None = None) -> DataFrame:
    """One row for each text with candidates, so that overlaps are settled without any grouping."""
    shared = items.sparkSession.sparkContext.broadcast(common)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"]):
                if own := candidates(text, shared.value):
                    votes = [",".join(map(str, c.votes)) for c in own]
                    rows.append((i, [c.type for c in own], [c.start for c in own], [c.end for c in own], votes, [features(text, c) for c in own]))
            yield pd.DataFrame(rows, columns=["id", "type", "start", "end", "votes", "features"])

    return spread(items.select(F.col("id").cast("string"), "text").where("text is not null")).mapInPandas(scan, CANDIDATES)


def train(found: DataFrame, common: np.ndarray | None = None, seed: int = 11) -> SpanModel:
    """The model for a table of candidates: votes of all of them, features of a bounded sample."""
    each = found.select("id", F.explode(F.arrays_zip("type", "votes", "features", "start")).alias("c")).select("id", "c.*")
    counts = each.groupBy("type", "votes").agg(F.count("*").alias("n")).collect()
    truth: dict[int, float] = {}
    for kind in range(len(TYPES)):
        own = {tuple(map(int, r.votes.split(","))): float(r.n) for r in counts if r.type == kind}
        if own:
            silent = SILENT if TYPES[kind] == "name" and common is not None else ()  # without usage, silence is all there is
            truth |= {_pattern(kind, v): p for v, p in aggregate_votes(own, silent=silent).items()}
    share = min(1.0, 0.9 * TRAIN_ROWS / max(1, sum(r.n for r in counts)))
    draw = F.pmod(F.xxhash64("id", "start", "type", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = each.where(draw).limit(TRAIN_ROWS).select("features").collect()
    return SpanModel(truth, SpanClassifier([r.features[1:] for r in sample], np.array([truth[r.features[0]] for r in sample])), common)


def find_personal(items: DataFrame) -> DataFrame:
    """``(id, pii_type, start_pos, end_pos, probability)`` of every piece found."""
    common = common_words(items)
    found = materialize(_candidate_table(items, common), "pii-candidates")
    shared = items.sparkSession.sparkContext.broadcast(train(found, common))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, kinds, starts, ends, feats in zip(*(batch[c] for c in ("id", "type", "start", "end", "features"))):
                own = [Candidate(int(k), int(a), int(b), ()) for k, a, b in zip(kinds, starts, ends)]
                for c, p in choose(own, [shared.value.probability(f) for f in feats]):
                    rows.append((i, TYPES[c.type], c.start, c.end, p))
            yield pd.DataFrame(rows, columns=["id", "pii_type", "start_pos", "end_pos", "probability"])

    return found.where("id is not null").mapInPandas(score, FOUND).distinct()


def redact(items: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``items`` with ``text`` replaced by the text with placeholders, all other columns kept.

    Without a ``model`` one is trained on the table's own candidates, which are written once for that.
    """
    if model is None:
        common = common_words(items)
        rows = items if "id" in items.columns else items.withColumn("id", F.xxhash64("text").cast("string"))
        model = train(materialize(_candidate_table(rows, common), "pii-candidates"), common)
    shared = items.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                if text:
                    for c, _ in reversed(shared.value.find(text)):
                        text = text[: c.start] + PLACEHOLDERS[TYPES[c.type]] + text[c.end :]
                out.append(text)
            yield pd.Series(out, dtype=object)

    return items.withColumn("text", masked("text"))
