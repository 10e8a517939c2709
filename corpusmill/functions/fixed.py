"""Values that results depend on: patterns, word lists, thresholds."""

# ---- Fixed values (formats and constants of the document rules; they must stay as they are) ----

HEADING_WORDS = (
    "abstract", "keywords", "contents", "references", "acknowledgments", "acknowledgements", "introduction", "conclusion",
    "appendix", "summary", "background", "methodology", "methods", "results", "discussion", "related work", "future work",
    "bibliography",
)
HEADING_MARKDOWN = r"^(#{1,6})\s+(.+)$"
HEADING_CHAPTER = r"^第[一二三四五六七八九十百千万\d]+[章节篇部分]\s*[：:、.]?\s*(.+)$"
HEADING_HAN = r"^[一二三四五六七八九十]+[、.]\s*(.+)$"
HEADING_NUMBER = r"^\d+(?:\.\d+){0,5}[、. ]\s*(.+)$"
HEADING_MAX_CHARS = 80
TOC_ROW = (r"\t+\s*-?\s*\d+\s*-?\s*$", r"\.{2,}\s*\d+\s*$", r"\s+-\s*\d+\s*-\s*$")
TOC_ENTRY = (*TOC_ROW, r"\s{4,}\d{1,4}\s*$", r"^\d+(?:\.\d+)*\s+.+\s+\d{1,4}$")
TOC_MARKERS = ("目录", "目錄")

IMAGE = (r"!\[[^\]]*\]\([^\)]+\)", r"!\[[^\]]*\]\[[^\]]+\]", r"(?i)<img\b[^>]*>")
SEPARATOR_CELL = r"^:?-{3,}:?$"
BULLET = r"^[•*-]\s*\S+"
BULLET_MARKERS = ("•", "-", "*")
FORMULA = r"[=≈≤≥]\s*[\p{L}\p{N}_({\[]"
FORMULA_MAX_CHARS = 160
FENCE = "```"

COVER_FIELDS = "院（系）|院\\(系\\)|专业|班级|学号|姓名|带队教师|指导教师|小组|组长|成员|队员|项目名称|课题名称|课题编号|报告名称|关联项目|调研范围|调研时间|研发周期"
COVER_SHORT = "院（系）|院\\(系\\)|专业|班级|学号|姓名|带队教师|指导教师|日期|小组|组长|成员|队员|项目名称|课题名称|课题编号|报告名称|关联项目|调研范围|调研时间|研发周期|年\\s*\\d+\\s*月|\\d{4}\\s*年"
COVER_LABEL = r"^(\S{1,8})\s{4,}(\S.{2,})\s{2,}[.。\d]*$"
COVER_COLON = r"^[\p{L}\p{N}_]{1,10}[：:]\s*\S.{2,}$"
COVER_DATE = r"^\d{4}年\d{1,2}月\d{1,2}日$"
COVER_WORDS = "实习|实训|总结报告|课程设计|开题报告"
COVER_BLOCKS = 24
BODY_TABLE_CHARS, BODY_TABLE_LINES, BODY_TABLE_MEAN = 1200, 6, 240

METRIC = r"(%|≥|≤|>=|<=|Recall@|nDCG|MRR|命中率|准确率|完整率|忠实度|可答性|目标值|验收标准|评价指标|技术指标|不破句率|整体成块率)"
METRIC_TERMS = (
    r"不破句率\s*[:：]?\s*\d+%",
    r"目标长度区间命中率\s*[:：]?\s*[≥>=\s]*\d+%",
    r"整体成块率\s*[:：]?\s*[≥>=\s]*\d+%",
    r"回链完整率\s*[:：]?\s*\d+%",
    r"Recall@k\s*/\s*nDCG\s*提升\s*[≥>=\s]*\d+%",
    r"Recall@\d+\s*[:：]?\s*[+\-]?\d+(?:\.\d+)?%",
    r"Precision@\d+\s*[:：]?\s*[+\-]?\d+(?:\.\d+)?%",
    r"MRR\s*[:：]?\s*[+\-]?\d+(?:\.\d+)?%",
    r"nDCG@\d+\s*[:：]?\s*[+\-]?\d+(?:\.\d+)?%",
)
AT_LEAST = "至少"

TOKEN = r"[一-鿿]|[A-Za-z0-9_]+|[^\s]"
SENTENCE = r"[^。！？!?；;.\n]+[。！？!?；;.]?"
SENTENCE_END = "[。！？…~；;」』】》）\"'`]$"
SUMMARY_END = "[。！？!?；;]"
SUMMARY_CHARS, DOC_SUMMARY_CHARS = 120, 300
WORD_RUN = r"[\p{L}\p{N}_]+"

ENTITY_DATE = r"\b\d{4}[-/.年]\d{1,2}([-/月.]\d{1,2}日?)?\b"
ENTITY_VERSION = r"(?i)\bv?\d+(?:\.\d+){1,3}\b"
QUOTED = ("《([^》]{2,30})》", "“([^”]{2,30})”", '"([^"\\n]{2,30})"')
ORG_SUFFIXES = ("公司", "集团", "大学", "学院", "研究院", "委员会", "中心", "局", "厅", "部")
TECH_TERMS = ("RAG", "LLM", "NLP", "API", "SDK", "Python", "FastAPI", "LangChain", "OpenAI", "Transformer", "向量数据库", "知识库", "分块", "检索")
MAX_ENTITIES, MAX_LABELS, MAX_TAGS = 10, 4, 5
TYPED_ENTITIES = (
    ("percentage", r"\d+(?:\.\d+)?%"),
    ("threshold", r"[≥≤>=<]+\s*\d+(?:\.\d+)?%?"),
    ("metric", r"(?i)(?:Recall|Precision|nDCG|MRR|F1|ROUGE|BLEU|Accuracy)(?:@\d+)?"),
    ("date", r"\d{4}\s*[年/-]\s*\d{1,2}\s*[月/-]\s*\d{1,2}\s*日?"),
    ("version", r"[Vv]\d+(?:\.\d+)+"),
    ("org_suffix", r"[一-鿿]{2,16}(?:大学|学院|研究所|实验室|公司|部门|中心|委员会|课题组|团队|平台|系统|框架|模型)"),
)
KEYWORD_STOPWORDS = (
    "以及", "为了", "通过", "可以", "进行", "实现", "这个", "我们", "你们", "他们", "然后", "相关", "其中", "一个", "一种",
    "about", "with", "from", "that", "this", "have", "will", "using",
    "chunk", "label", "labels", "字段", "内容", "文档", "示例", "说明",
)
TAG_TOKEN = r"[一-鿿]+|[A-Za-z0-9_]+|[^\s]"
TAG_STOPWORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去",
    "你", "会", "着", "没有", "看", "好", "自己", "这", "他", "她", "它", "们", "那", "些", "所", "为", "所以", "因为",
    "但是", "然而", "虽然", "如果", "可以", "这个", "那个", "这些", "那些", "什么", "怎么", "如何", "为什么", "进行", "使用",
    "通过", "以及", "或者", "其中", "其他", "之后", "一种", "用于", "基于", "针对", "关于",
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "can", "shall", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "this", "that", "these", "those", "it", "its", "and", "but", "or", "not", "no",
    "such", "each", "all", "both", "few", "more", "most",
)
BIGRAM_CHARS = 12

SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ";", ". ", ".", "，", "、", ",", ":", "：", " ", "")
PROTECTED = ("table", "formula", "code")
VECTOR_SIZE = 256
RETRIEVAL_WEIGHTS = (0.65, 0.35, 0.05)
CANDIDATE_FACTOR, CANDIDATE_MIN = 4, 20
BOOST_STEP, BOOST_CAP, BOOST_METRIC = 0.025, 0.08, 0.05
QUERY_TERM = r"[A-Za-z][A-Za-z0-9_@.+-]{1,}|[一-鿿]{2,}"
QUERY_PHRASES = ("技术难点", "验收标准", "评价指标", "技术方案", "项目创新点", "差异化优势", "固定长度", "语义感知", "结构感知", "下游检索", "闭环评估")
METRIC_QUERY = "(?i)(验收|指标|命中率|准确率|完整率|Recall|nDCG|MRR|%|多少)"
EVIDENCE = r"(\d+%|≥|≤|>=|<=|Recall@|nDCG|MRR|命中率|准确率|完整率)"
LEXICAL_TOKEN = "[一-鿿A-Za-z0-9_]+"
JUDGE_KEYWORDS, JUDGE_SEMANTIC, JUDGE_SEMANTIC_WITH_KEYWORDS = 0.34, 0.45, 0.57
QA_ANSWERABLE, QA_FAITHFUL = 0.3, 0.5
QA_MIN_CHARS, QA_MAX_URLS, QA_MANY_LINES, QA_SHORT_LINE = 300, 3, 8, 40
PASS_GAIN, PASS_SEMANTIC, PASS_QA, BAD_RECALL = 0.10, 0.85, 0.90, 0.3
# ---- end of fixed values ----
