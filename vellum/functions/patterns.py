"""Patterns and word lists, in syntax that Java's, Python's and RE2's engines read alike."""

from __future__ import annotations

# Building blocks: white space, Chinese characters and word characters of any script; dashes that join numbers.
S = "[\\s\u0085   -     　]"
#: The same white space, letter by letter.
WHITE = " \t\n\x0b\f\r\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CJK = "[一-鿿]"
W = "[\\p{L}\\p{N}_]"
NOT_W = "[^\\p{L}\\p{N}_]"
DASH = "[-.−–—－]"
NUMBER = f"[0-9]+(?:{S}*{DASH}{S}*[0-9]+)*"


def whole(words: str) -> str:
    """The words with no word character next to them."""
    return f"(?:^|{NOT_W})(?:{words})(?:$|{NOT_W})"


# ---- fixed values ----
REFERENCE_TITLES = ("参考文献", "Reference", "References")
REFERENCE_TITLE = f"^{S}*(?:{'|'.join(f'{S}*'.join(t) for t in REFERENCE_TITLES)})[：:{S[1:]}*$"
TOC_DOTS = f"[.·…]{{5,}}{S}*[0-9]+{S}*$"
TOC_SPACES = f"{S}{{5,}}[0-9]+{S}*$"
CAPTION = f"(?i)^(?:图|表|Figure|Fig\\.|Table){S}*[0-9]+"
CODE_WORDS = "def|class|import|return|if|else|elif|for|while|try|except|finally|public|private|protected|void|int|float|double|char|bool|var|let|const|function|switch|case"
STOP_WORDS = "the|is|are|where|which|with|and|that|this|in|on|at|to|of|we|set|let|then|if|assume|given|step|note|figure|table|data|value|width|height|size|parameter"
GLYPHS = "[∑∫√≈≠≤≥±×÷α-ωΑ-Ω∂∇∞]"
OPERATORS = "[=<>≤≥±×÷*/+\\-≈≠]"
NUMBERED_END = "(?:（[0-9]+(?:[-.][0-9]+)*）|\\([0-9]+(?:[-.][0-9]+)*\\))"
INDEXED = f"{W}\\[[^\\]]+\\]"
LATEX = "(?:\\\\[a-zA-Z]+|\\^|\\{.*\\})"
HEADING = f"^([0-9]+(?:\\.[0-9]+)*)(?:[.、]|{S}+)(.+)$"
HEADING_DATE = f"^[0-9]{{2,4}}{S}*年"
HEADING_CHAPTER = "^第[一二三四五六七八九十百]+[章节]"
HEADING_NOT = ("if", "for", "while", "else", "elif", "return", "break", "continue", "pass", "then", "begin", "end")
HEADING_PARTS_CHAPTER = "^第([0-9一二三四五六七八九十百千两零]+)[章节]"
RUNNING_CHAPTER = "^第[0-9一二三四五六七八九十百千两零]+章$"
CN_DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000}
TOC_LEADER = f"(?:\\.{{3,}}|…{{2,}}|·{{3,}}|_{{3,}}|-{{5,}}){S}*[0-9]+{S}*$"
TOC_LEADER_SHORT = "(?:\\.{2,}|…{2,})"
TOC_GAP = f"{S}{{2,}}[0-9]+{S}*$"
CITATION_CODE = f"(?:{W}{S}*:=|(?:^|{NOT_W})(?:return|for|while|if)(?:$|{NOT_W})|==|!=|->|=>|;|\\{{|\\}}|{INDEXED}|{W}{S}*={S}*{W}+{S}*\\()"
CITATION_GROUP = f"\\[([0-9]+(?:{S}*,{S}*[0-9]+)*)\\]"
CITATION_AUTHOR = "\\([A-Za-z][^)]{0,40}[0-9]{4}[^)]*\\)"
REGION_CITATION = f"\\[{S}*([0-9]+(?:{S}*,{S}*[0-9]+)*){S}*\\]"
AUTHOR_YEAR = f"\\(([^()]*[A-Za-z][A-Za-z'\\-]+(?:{S}+et{S}+al\\.)?[^()]*?,{S}*[0-9]{{4}}[a-z]?[^()]*)\\)"
AUTHOR_YEAR_ANY = "\\(([^()]*[0-9]{4}[a-z]?[^()]*)\\)"
REFERENCE_LONE = f"^{S}*\\[[0-9]+\\]{S}*$"
REFERENCE_START = f"^{S}*(?:\\[[0-9]+\\]|[0-9]+\\.)"
REFERENCE_SPACED = f"^{S}*(?:\\[[0-9]+\\]|[0-9]+\\.){S}"
REFERENCE_ITEM = f"^{S}*(?:\\[[0-9]+\\]|[0-9]+\\.){S}+[^\\s]"
REFERENCE_WORDS = "(?i)(?:vol\\.|pp\\.|no\\.|doi|http|isbn|issn|journal|conference|proceedings|trans\\.|rev\\.|arxiv|reference|references|学报|会议|论文集|出版社|pages|et al\\.?|eds\\.?|\\[[A-Z]{1,2}(?:/[A-Z]+)?\\])"
REFERENCE_TITLE_LOOSE = f"(?i)^{S}*(?:参考文献|references?){S}*$"
REFERENCE_NUMBER = f"^{S}*(?:\\[([0-9]+)\\]|([0-9]+)[.)])"
LAYOUT_REFERENCE_NUMBER = f"^{S}*(?:\\[{S}*([0-9]+){S}*\\]|［{S}*([0-9]+){S}*］|\\({S}*([0-9]+){S}*\\)|（{S}*([0-9]+){S}*）|([0-9]+)\\.|([0-9]+){S})"
LAYOUT_AUTHOR_YEAR = "[（(].*[0-9]{4}[a-z]?[)）]"
LAYOUT_GROUP = "[\\[［]([^\\]］]{1,50})[\\]］]"
LAYOUT_SPLIT = f"(?:{S}|[,;，；])+"
CAPTION_NUMBER = f"(?i)^{S}*(?:图|表|Figure|Fig\\.?|Table){S}*({NUMBER})"
FIGURE_CAPTION = "(?i)^(?:图|Figure|Fig\\.?)"
TABLE_CAPTION = "(?i)^(?:表|Table)"
MENTION = f"(?:图|表|Figure|Fig\\.?|Table){S}*({NUMBER})"
FORMULA_MENTIONS = (f"(?:式|公式){S}*[（(]?{S}*({NUMBER})", f"(?i)(?:Eq\\.?|Equation){S}*[(（]?{S}*({NUMBER})")
FORMULA_PAREN = f"[（(]({NUMBER})[）)]"
FORMULA_END = f"[（(]({NUMBER})[）)]{S}*$"
FORMULA_ONLY = f"^{S}*[（(]({NUMBER})[）)]{S}*$"
POSITION = f"[，。,.]{S}*\\[[0-9]+\\]"
SENTENCE_END = "[。！？]"
ISSUE_RULES = {
    "Citation_Inconsistency": ("001", "引用一致性"),
    "Citation_Style_Inconsistent": ("002", "参考文献格式一致性"),
    "Label_Missing": ("003", "图表题注与引用"),
    "Hierarchy_Fault": ("004", "标题层级与编号"),
    "Punctuation_Mixed": ("005", "标点符号规范"),
    "Punctuation_Error": ("005", "标点符号规范"),
    "Typo_Error": ("006", "错别字/书写错误"),
    "Typo_Limit_Exceeded": ("006", "错别字红线"),
    "Formula_Readability": ("007", "公式可读性"),
    "Formula_Missing": ("008", "公式编号规范"),
    "Formula_Ref_Missing": ("009", "公式引用规范"),
    "Formula_Misaligned": ("010", "公式排版规范"),
    "Formatting_Issue": ("011", "排版与格式"),
    "Experiment_Result_Question": ("012", "实验结果疑问"),
}
RULE_PREFIX = "FMT"
# Words in reviewers' remarks, a list for each thing that must be named, and the type or severity they tell.
REMARK_TYPES = (
    ("Typo_Error", (("错别字", "书写错误", "别字", "笔误", "语病"),)),
    ("Experiment_Result_Question", (("实验", "结果", "数据"), ("疑问", "原因", "过拟合", "为什么", "是否", "\\?", "？"))),
    ("Hierarchy_Fault", (("标题",), ("编号", "连续", "层级"))),
    ("Label_Missing", (("图", "表"), ("标题", "题注", "标注"), ("缺", "无"))),
    ("Citation_Style_Inconsistent", (("参考文献",), ("格式", "排版"))),
    ("Citation_Reference_Missing", (("参考文献", "引用", "标注", "【", "\\["), ("缺", "未", "找不到"))),
    ("Citation_Inconsistency", (("参考文献", "引用", "标注", "【", "\\["),)),
    ("Formula_Readability", (("公式",), ("不可读", "模糊", "看不清"))),
    ("Punctuation_Mixed", (("标点",), ("混用", "不一致"))),
    ("Formatting_Issue", (("格式", "排版", "字体", "字号", "行距", "页眉", "页脚", "对齐", "缩进", "空格", "标点"),)),
)
REMARK_SEVERITIES = (
    ("Critical", ("无法", "严重", "不可用", "致命")),
    ("Warning", ("错误", "缺失", "缺少", "不一致", "不可读", "模糊", "问题", "质询", "错别字", "书写错误", "语病")),
)
#: Headings of the part of a review that lists its remarks: words that one heading has together, the first list first.
REMARK_HEADINGS = ((("质询问题",),), (("论文存在的主要问题",), ("主要问题", "修改意见")))
REMARK_ITEM = f"^([0-9]{{1,2}}){S}*[.、)）]{S}*(.+)$"
#: Marks that matching leaves out.
MARKS = "[，,。.；;：:、!！?？()（）\\[\\]【】“”\"'‘’]"
#: Labels of a result.
TAGS = ("Citation_Inconsistency", "Label_Missing", "Hierarchy_Fault", "Punctuation_Error")
#: Types of issues that a language model may report, and what is noted where a missing citation is only a line of its own.
MODEL_TYPES = ("Terminology_Inconsistency", "Terminology_Forbidden", "Terminology_Language", "Abbreviation_Definition", "Citation_Placeholder")
LONE_CITATION = " (疑似排版或解析造成的孤立行，非内容缺失)"
LONE_WORDS = ("孤立", "单独成行")

#: Still fixed values. Formula cascade: (verdict, conditions), the first step whose conditions all hold decides. A condition is a pattern
#: found ("has") or not ("not"), or a comparison of length, share of Chinese characters or number of operators.
FORMULA = (
    (False, (("longer", 160),)),
    (False, (("has", f"[。！？]{S}*$"),)),
    (False, (("has", "。"), ("longer", 25))),
    (False, (("has", TOC_DOTS),)),
    (False, (("has", f"{CJK}{S}*/{S}*{CJK}"),)),
    (False, (("has", "[;{}]$"),)),
    (False, (("has", f"^{S}*(?:{CODE_WORDS})(?:$|{NOT_W})"),)),
    (False, (("has", "(?://|/\\*|#[\\s])"),)),
    (False, (("has", f"(?:^|{NOT_W})[a-zA-Z]{{2,}}_[a-zA-Z]{{2,}}(?:$|{NOT_W})"),)),
    (False, (("has", f"{W}{S}*={S}*{W}+{S}*\\("), ("has", INDEXED))),
    (False, (("has", INDEXED), ("has", "(?:==|!=|:=)"))),
    (False, (("has", "grid ?\\["),)),
    (False, (("has", f"^{S}*(?:•|o|\\*|-|[0-9]+\\.){S}"),)),
    (False, (("has", f"^{S}*[0-9]+{S}*[)）]"), ("has", "[:：]"))),
    (False, (("has", ":="), ("has", "[A-Za-z]"), ("not", GLYPHS))),
    (False, (("has", f"(?:https?://|@[\\p{{L}}\\p{{N}}_.]+)"),)),
    (False, (("has", "(?i)" + whole(STOP_WORDS)),)),
    (False, (("has", f"^(?:[A-Za-z]|{S})+={S}*[0-9]+(?:\\.[0-9]+)?{S}*[a-zA-Z%]*$"),)),
    (False, (("has", f"^[（(]{S}*[A-Za-z][A-Za-z0-9_]{{1,20}}{S}*={S}*[-+]?[0-9]+(?:\\.[0-9]+)?{S}*[A-Za-z%]{{0,6}}{S}*[0-9]{{0,3}}{S}*[)）]$"),)),
    (False, (("has", GLYPHS), ("chinese", 0.2), ("has", "。"))),
    (False, (("has", GLYPHS), ("chinese", 0.2), ("longer", 35))),
    (False, (("has", GLYPHS), ("chinese", 0.2), ("fewer", 2), ("not", "="))),
    (True, (("has", GLYPHS),)),
    (False, (("has", f"^{NUMBERED_END}$"),)),
    (True, (("has", f"{NUMBERED_END}$"),)),
    (True, (("has", LATEX),)),
    (False, (("not", "[=<>≈]"),)),
    (False, (("has", "(?:==|!=|&&|\\|\\||->|=>)"),)),
    (False, (("has", INDEXED), ("has", f"{W}{S}*="))),
    (False, (("chinese", 0.2),)),
    (False, (("longer", 120),)),
    (False, (("not", "[0-9A-Za-zα-ωΑ-Ω]"),)),
)
FORMULA_ELSE = True

DISPLAY = (
    (True, (("has", FORMULA_END),)),
    (False, (("has", ":="),)),
    (False, (("has", f"[；;。]{S}*$"),)),
    (False, (("has", f"[(\\[（【{{⟨<]{S}*$"),)),
    (False, (("has", f"^{S}*[0-9]+{S}*:{S}*[^\\s]"),)),
    (False, (("has", f"^{S}*[0-9]+\\){S}+[^\\s]"),)),
    (False, (("has", f"^{S}*[0-9]+{S}*且{S}+[^\\s]"),)),
    (False, (("has", f"^[^0-9\\s()【】\\[\\]{{}}<>]{{1,2}}{S}*[:：]{S}*[^\\s]"),)),
    (False, (("has", "[∧∨¬⇒⇔]"),)),
    (False, (("has", "(?:其中|定义|我们|令|则|即|表示)"),)),
    (False, (("has", "^!\\([^)]*\\)$"),)),
    (False, (("has", f"^\\[{S}*!\\([^)]*\\){S}*\\]$"),)),
    (False, (("has", "⟨"), ("not", "⟩"))),
    (False, (("has", "⟩"), ("not", "⟨"))),
    (False, (("has", "\\{"), ("not", "\\}"))),
    (False, (("has", "\\}"), ("not", "\\{"))),
    (False, (("has", "⟨[^⟩]+⟩"), ("has", ","))),
    (False, (("has", "←"),)),
    (False, (("has", f"^{S}*算法{S}*[0-9]"),)),
    (False, (("has", "[。˙]"),)),
    (False, (("has", "(?:\\[\\]|\\{\\}|return[\\s]|def[\\s]|class[\\s]|import[\\s]|print\\()"),)),
    (False, (("has", f"{OPERATORS}{S}*$"),)),
    (False, (("chinese", 0.15),)),
    (False, (("has", f"^[^,，=]*=[^,，]*(?:[,，]+[^,，=]*=[^,，]*)*,[^,，=]*=[^,，]*(?:[,，]+[^,，=]*=[^,，]*)*[,，]*$"), ("not", "[∧∨¬⇒⇔∑∫√]"))),
    (False, (("has", f"^[^\\s]+{S}*[≤≥<>]{S}*[^\\s]+(?:{S}*[+\\-−–—]{S}*[0-9]+(?:\\.[0-9]+)?)?$"),)),
    (False, (("has", f"^[A-Za-zα-ωΑ-Ω]{W}{{0,3}}{S}*[≤≥<>]=?{S}*-?[0-9]+(?:\\.[0-9]+)?$"),)),
    (False, (("shorter", 7),)),
    (False, (("has", f"^[0-9.]+{S}*[×xX*]{S}*10{S}*[-−]?[0-9]+$"),)),
    (False, (("has", f"^[A-Za-z]+{S}*={S}*[0-9.]+$"),)),
    (False, (("has", f"^[0-9.]+{S}*[+\\-−–—]{S}*[0-9.]+$"),)),
    (False, (("has", f"{CJK}{S}*[,，]?{S}*[A-Za-z]+{S}*={S}*[0-9.]+$"),)),
    (False, (("has", "[，。、：]"),)),
    (True, (("has", OPERATORS),)),
    (True, (("has", "[∑∫√∂∇∞]"),)),
    (True, (("has", LATEX),)),
)
DISPLAY_ELSE = False
