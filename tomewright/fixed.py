"""Fixed values.

The word lists, character classes, patterns and formats below define the text
conventions that the audited documents follow.  They are data, not logic: two
engines can only agree on results when these agree.  Patterns are written for
the Java regex engine behind Spark; ``(?U)`` makes ``\\s`` Unicode aware and
``(?d)`` makes ``\\n`` the only line terminator.
"""

# -- whitespace and flags -------------------------------------------------
U = "(?Ud)"
WS = r"[\s\x1C-\x1F]"           # what a Unicode-aware strip removes
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
            "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WS_INLINE = r"[^\S\n]"          # the same without the newline

# -- encodings ------------------------------------------------------------
ENCODINGS = ["utf-8-sig", "utf-8", "gb18030", "utf-16", "big5"]
ENCODING_GOOD_SCORE = 0.2
ENCODING_SAMPLE_CHARS = 200_000
REPLACEMENT_PENALTY = 10

# -- numerals -------------------------------------------------------------
CN_DIGIT_ORDER = "零一二三四五六七八九"
CN_DIGIT_VARIANTS = ("〇两", "零二")
CN_UNIT_ORDER = "十百千万"
NUM = "[0-9〇零一二三四五六七八九十百千万两]{1,12}"
CN_NUM_ONLY = "^[〇零一二三四五六七八九十百千万两]+$"

# -- boilerplate lines ----------------------------------------------------
AD_LINE = U + (
    r"请收藏本站|更新最快|最快更新|手机版阅读|手机用户请|笔趣阁|www\.|https?://"
    r"|天才一秒记住|一秒记住|本章未完|内容严重缺失|章节错误|加入书签|投推荐票"
    r"|求收藏|求订阅|求月票|读者群|QQ群|微信公众号|app下载|APP下载"
    r"|^\s*[（(]?本章完[）)]?\s*$|^\s*[（(]?未完待续[）)]?\s*$"
)

# -- headings -------------------------------------------------------------
MAX_HEADING_CHARS = 50
FULL_STOP = "。"
SPECIAL_HEADINGS = ("序章", "序言", "序", "楔子", "引子", "前言", "尾声", "终章", "结局",
                    "后记", "番外", "外传", "附录", "完本感言")
VOLUME_HEADING = U + rf"^(?:[【\[]\s*)?第\s*({NUM})\s*([卷部篇])\s*(?:[】\]])?\s*(.{{0,60}})$"
CHAPTER_HEADING = U + rf"^(?:[【\[]\s*)?第\s*({NUM})\s*([章回节話话])\s*(?:[】\]])?\s*(.{{0,60}})$"
LATIN_HEADING = U + r"^(?:Chapter|CHAPTER|Ch\.|ch\.)\s*([0-9]{1,5})\b\s*(.{0,60})$"
NUMBERED_HEADING = U + r"^([0-9]{1,4})\s*[.、,，:：]?\s+(.{0,60})$"
NUMBERED_HEADING_LOOSE = U + r"^([0-9]{1,4})\s*(?:[.、,，:：]\s*|\s+)(.{0,60})$"
SPECIAL_HEADING = U + rf"^({'|'.join(SPECIAL_HEADINGS)})\s*[·:：]?\s*(.{{0,40}})$"
CHUNK_CHARS = 8000
CHUNK_TITLE = "分块{}（自动，非真实章节）"
SHORT_CHAPTER_CHARS = 200

# -- file names -----------------------------------------------------------
TITLE_NUMBER_PREFIX = U + rf"^第\s*{NUM}\s*[章回节話话卷部篇]\s*"
FILE_UNSAFE = r'[\\/:*?"<>|\n\r\t]'
FILE_TITLE_CHARS = 40
UNTITLED = "未命名"

# -- quotations -----------------------------------------------------------
QUOTE_CHARS = "「」『』“”\"'‘’《》〈〉"
QUOTE_EDGE = QUOTE_CHARS + " \t"
ELLIPSIS = r"\.{2,}|…+|﹍+|——+|\*{2,}"
MIN_SEGMENT_CHARS = 4
SLICE_MARKER = r"(?:\*\*)?\s*【原文\s*[·・:：]?\s*([^】]*)】\s*(?:\*\*)?\s*(.*)$"
SLICE_MARKER_LINE = U + r"^\s*" + SLICE_MARKER
SLICE_SHARE_ALARM = 0.25
SLICE_SHARE_ADVICE = 0.15
SLICE_CHARS_RANGE = (80, 500)
REASON_SHORT = "切片内容为空或过短"
REASON_ORDER = "片段顺序与原文不一致（可能跨段拼接时顺序写反）"
REASON_MISSING = "{} 段在原文中找不到：{}…"
REASON_CHAPTER = "标注为 {}，但这段文字出现在 {}（可能抄错章号，或该段落原文本身跨章）"

# -- chapter references ---------------------------------------------------
COVER_RANGE = U + rf"第?\s*({NUM})\s*(?:章)?\s*[-–—~～至到]\s*({NUM})\s*章"
COVER_SINGLE = U + rf"第\s*({NUM})\s*[章回节話话]"
LINK_RANGE = U + rf"第?\s*({NUM})\s*(?:章)?\s*[–—~～\-至到]\s*({NUM})\s*[章回]"
LINK_SINGLE = U + rf"第\s*({NUM})\s*[章回]"
LIST_RANGE = U + r"([0-9]{1,6})\s*[–—~～\-至到]\s*([0-9]{1,6})"
LIST_SINGLE = "[0-9]{1,6}"
LIST_SPAN_CAP = 300

# -- digest structure -----------------------------------------------------
UNIT_HEADING = U + r"^##\s*单元\s*([0-9〇零一二三四五六七八九十百]*)\s*[｜|：:、,.\-—]?\s*(.*)$"
UNIT_RANGE = U + r"[（(]\s*第?\s*([0-9]{1,6})\s*[–—~～\-至到]\s*([0-9]{1,6})\s*章?\s*[）)]"
BULLET = U + r"^[-*+]\s+"
ORDERED = U + r"^[0-9]+[.)]\s+"
RULE = r"^(?:-{3,}|\*{3,}|_{3,})$"
TABLE_RULE_CELL = r"^:?-{2,}:?$"
CH_LIST = r"[0-9][0-9、,，和及\s–—~～\-至到]*?"
ENTRY_LEVEL = U + rf"^\*\*第\s*{CH_LIST}章\s*[（(](详|略)[）)]"
ENTRY_CHAPTERS = U + rf"^\*\*第\s*({CH_LIST})\s*章"
SECTION_LINE = U + r"^\*\*【(重要|过渡)】\*\*\s*$"
INLINE_SECTION = "(?Uds)" + r"^【(重要|过渡)】\s*(.*)$"
UNIT_END = r"^\*\*这一段结束时\*\*"
UNIT_LINE = U + r"^##\s*单元"
SLICE_LINE = U + r"^\*\*【原文[·・:：]?\s*([^】]*)】\*\*\s*$"
ENTRY_HEAD = "(?Uds)" + r"^\*\*(.+?)\*\*\s*([（(][^）)]*[）)])?\s*[：:]\s*(.*)$"
NUMBER_FIRST = "(?Uds)" + rf"^第\s*({CH_LIST})\s*章\s*(.*)$"
NUMBER_LAST = "(?Uds)" + rf"^(.*?)\s*[（(]第\s*({CH_LIST})\s*章[^）)]*[）)](.*)$"
DONE_ENTRY = r"^\*\*第[^*]*[（(](详|略)[）)]"
SHORT_NOTE_CHARS = 16
LEVEL_KEY, LEVEL_BRIEF = "详", "略"
SECTION_KEY = "重要"
NO_CHAPTER = 10 ** 7
CROSS_SEGMENT_WORD = "跨段"
TITLE_RANGE_TAIL = U + r"[（(].*?[）)]\s*$"

# -- people ---------------------------------------------------------------
NAME_HEADERS = ("本名", "真名", "姓名", "人物", "角色")
ALIAS_HEADERS = ("马甲", "尊称", "别名", "别称", "化名", "道号", "代号",
                 "称呼", "称号", "外号", "原名", "曾用名")
ALIAS_PREFIX = r"^(?:又称|亦称|也称|又被称为|被称为|被称作|称作|叫做|也叫|即是|即)"
ALIAS_SPLIT = r"[、,，/／|;；]+"
ALIAS_PLACEHOLDER = r"^(?:[-‐‑‒–—―]+|无|暂无|无别名|未知|未详)$"
ALIAS_NOTE = r"起实为|实为|真名自报|自报于|人族旧识|名讳|身份|所化假身|均无名|无名全称"
GENERIC_NAMES = ("仙子", "前辈", "道友", "师兄", "师姐", "师弟", "师妹", "师尊",
                 "老祖", "真人", "大人", "道长", "尊者", "圣祖")
ALIAS_MAX_CHARS = 8
MENTION_MIN_CHARS = 2
EMPHASIS = r"[*`]+"
PAREN_NOTE = r"（[^）]*）|\([^()]*\)"
NON_PERSON_TITLES = ("别名", "归一", "索引", "目录")

# -- shelf ----------------------------------------------------------------
PAGE_NAMES = ("速读稿.html", "衔接包.html")
PAGE_MARKER = 'id="page-data"'
PAGE_MARKER_CHARS = 8192
PAGE_TITLE = "(?s)<title>(.*?)</title>"
PAGE_DATA = '(?s)<script id="page-data" type="application/json">(.*?)</script>'
SHELF_RANGE = U + r"第\s*([0-9]{1,6})\s*[–—~～\-至到]\s*([0-9]{1,6})\s*章?"
SHELF_RANGE_SPAN = 5000
RANGE_ONLY_LABEL = U + r"^第[0-9〇零一二三四五六七八九十百千万两\s、,，和及\-–—~～至到]+章?$"
RANGE_TAIL = U + r"[（(]\s*第\s*[0-9]+[^（）()]*?章\s*[）)]\s*$"
BOOK_NAME = "《([^《》]+)》"
DEFAULT_CARD_TITLE = "速读稿"
BRIDGE_WORD = "衔接"
LOOSE_GROUP = "@@loose"
NO_RANGE_START = 10 ** 9
MD_LINK = U + r"^\[(.+?)\]\((.+?)\)\s*$"
ITEM_SEPARATORS = "｜：:|"
PROGRESS_DONE = "已读完 ✓"
PROGRESS_PART = "读到 {}%"
PROGRESS_THROTTLE = "700 milliseconds"
