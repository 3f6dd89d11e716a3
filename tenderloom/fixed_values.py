"""Fixed values.

Word lists, patterns, formats and constants in this file are part of the results: they have to equal the
documented behaviour of the retrieval application, so they are stated here as they are, in their natural order.
"""

# ---------------------------------------------------------------- numbers
TEXT_LIMIT = 20_000
SECTION_MIN_LENGTH = 50
DEFAULT_TOP_K = 10
DEFAULT_TOP_N = 5
EOK = 100_000_000
MAN = 10_000
BUDGET_KNOWN_FROM = 1_000_000
DEADLINE_AFTER_OPEN_DAYS = 30
URGENT_DAYS = 7
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SPACING_RATIO = 0.15
HYBRID_ALPHA = 0.6
SOURCE_OVERLAP_WEIGHT = 0.3
HARD_THRESHOLD = 2
BM25_K = 1.2
BM25_B = 0.75
BM25_AVERAGE_LENGTH = 256.0
BM25_TOKEN_MAX = 40
SUMMARY_CHUNKS = 3
SUMMARY_SENTENCES = 2
SUMMARY_LIMIT = 400
CONTEXT_RESULTS = 6
CONTEXT_CHARS = 700
EXPANSION_CAP = 3
JUDGE_CONTEXT_LIMIT = 6000
LABEL_MIN_SCORE = 0.85
LABEL_PER_SOURCE = 20
HISTORY_LENGTH = 5
SUMMARY_EXCHANGES = 3
ANSWER_EXCERPT = 100
ANOMALY_MIN_SAMPLES = 10
ANOMALY_SECONDS = 60.0
ANOMALY_FACTOR = 3.0
INTENT_CACHE_SIZE = 256
SIGNATURE_TOKENS = 12

# ---------------------------------------------------------------- names and particles
JOSA = ["의", "은", "는", "이", "가", "께서", "에서", "에게"]
ORG_ALIASES = {"서울시": "서울특별시", "고려대": "고려대학교", "서울시립대": "서울시립대학교"}
MISSING_WORDS = ["nan", "none", "null", "-", "정보 없음", "정보없음"]
DOCUMENT_EXTENSIONS = ["pdf", "hwp", "hwpx", "csv"]
CONVERTED_EXTENSIONS = ["hwp", "hwpx", "pdf"]
LEGAL_UNITS = ["편", "장", "절", "조", "항"]
LETTER_MARKERS = "가나다라마바사아자차카타파하"

# ---------------------------------------------------------------- metadata key priorities
SOURCE_KEYS = ["source", "source_file", "filename", "파일명"]
PAGE_KEYS = ["page", "page_start", "page_no"]
ORG_KEYS = ["org", "org_name", "institution", "발주 기관", "발주기관", "기관명"]

# ---------------------------------------------------------------- notice CSV
NOTICE_CSV_COLUMNS = {
    "공고 번호": "notice_no",
    "공고 차수": "notice_round",
    "사업명": "project",
    "사업 금액": "amount",
    "발주 기관": "org",
    "공개 일자": "open_date",
    "입찰 참여 시작일": "bid_start",
    "입찰 참여 마감일": "bid_end",
    "사업 요약": "summary",
    "파일형식": "file_format",
    "파일명": "file_name",
    "텍스트": "body",
}
NOTICE_MARKDOWN = """# {org} {project}

## 기본 정보
- **공고 번호**: {notice_no}
- **공고 차수**: {notice_round}
- **사업명**: {project}
- **발주 기관**: {org}
- **사업 금액**: {amount}
- **공개 일자**: {open_date}
- **입찰 시작일**: {bid_start}
- **입찰 마감일**: {bid_end}

## 사업 요약
{summary}

## 파일 정보
- **파일 형식**: {file_format}
- **파일명**: {file_name}

## 원본 문서 내용
{body}
"""
CHECKLIST_ROWS = [
    ("참가자격 확인", "", "업종/실적/인력 요건"),
    ("제출서류 준비", "", "제안서/가격입찰서/증빙"),
    ("평가기준 분석", "", "기술/가격 배점"),
    ("마감일 검토", "", "접수 채널 및 시간"),
]
URGENCY_CLOSED = "⛔ 마감"
URGENCY_3_DAYS = "🔴 긴급"
URGENCY_7_DAYS = "🟡 임박"
URGENCY_LATER = "🟢 여유"
URGENCY_UNKNOWN = "⚪ 미확인"

# ---------------------------------------------------------------- amounts and tax in text (patterns)
AMOUNT_PATTERNS = [
    r"사\s*업\s*비\s*[:：]\s*금([\(]?[\d,]+[\)]?)원",
    r"금\s*액\s*[:：]\s*([\d,]+)원",
    r"금([\d,]+)원",
    r"사\s*업\s*비\s*[:：]?\s*([\d,]+)원",
    r"계약\s*금\s*액\s*[:：]\s*([\d,]+)원",
    r"예\s*산\s*[:：]\s*([\d,]+)원",
    r"총\s*사\s*업\s*비\s*[:：]\s*([\d,]+)원",
]
AMOUNT_UNIT_PATTERN = r"사\s*업\s*비\s*[:：]?\s*([\d.]+)\s*(억|만)\s*원"
VAT_WORD = r"(부가가치세|부가세|vat)"
VAT_INCLUDED_WORD = r"(포함|포함금액|포함조건)"
VAT_EXCLUDED_WORD = r"(별도|제외|미포함)"
VAT_GAP = r".{0,12}"
VAT_QUERY_WORDS = ["부가가치세", "부가세", "vat", "세금 포함", "세 포함"]
TIME_QUERY_WORDS = ["시간", "시각", "몇시", "몇 시", "오전", "오후", "시분"]

# ---------------------------------------------------------------- headings (patterns, priority order)
HEADING_PATTERNS = {
    "legal": r"제\s*\d+\s*[장절조편항][\s.:]\s*.+",
    "numbered_d3": r"\d+\.\d+\.\d+(?:\.\d+)*\.?\s+\S.+",
    "numbered_d2": r"\d+\.\d+\.?\s+\S.+",
    "numbered_d1": r"(?:1[0-9]|[1-9])\.\s+\S.+",
    "roman": r"[IVXivxⅠ-Ⅻⅰ-ⅻ]+\.\s+\S.+",
    "korean_letter": r"[가-하]\.\s+\S.+",
    "bracket": r"\[.+\]\s*.*",
}
LEGAL_TYPE_PATTERN = r"제\s*\d+\s*([장절조편항])"
ROMAN_HEAD_PATTERN = r"^([IVXivxⅠ-Ⅻⅰ-ⅻ]+)\s*\.?\s+(.+)$"
ROMAN_WITHOUT_DOT_PATTERN = r"^([IVXivxⅠ-Ⅻⅰ-ⅻ]+)\s+(.+)"
PAGE_MARKER_PATTERN = r"<<PAGE:\s*(\d+)>>"
TOC_SEPARATOR_PATTERN = r"[-·―─━│┃═║…⋯・.]{5,}"

# ---------------------------------------------------------------- cleaning (patterns)
AUDIT_BULLETS = "○●■※◆◇▶▷►"
CLEAN_BULLETS = "○□❍❏◎◇▶▷►●■★☆◆▪▸ｏ"
RUNNING_HEAD_PATTERNS = [
    r"^[ \t]*-?\s*\d{1,4}\s*-?[ \t]*$",
    r"^[ \t]*\d{1,4}\s*/\s*\d{1,4}[ \t]*$",
    r"^[ \t]*제\s*안\s*요\s*청\s*서[ \t]*$",
    r"^[ \t]*\(?\s*비\s*밀\s*\)?\s*$",
]
RULE_LINE_PATTERN = r"^[ \t]*[-_=]{3,}[ \t]*$"
GENERIC_TABLE_HEADERS = ["항목", "내용", "구분", "설명", "비고", "분류", "세부내용"]
PLACEHOLDER_HEADER_PATTERN = r"(?i)^(Col(umn)?\s*\d+)$"
TABLE_PREFIX_MAX = 80

# ---------------------------------------------------------------- extracted lines
LINE_CLEAN_STEPS = [
    (r"^\s*(?:[-*•]\s*)+", ""),
    (r"^\s*#+\s*", ""),
    (r"\*\*", ""),
    (r"(?i)\bCol\s*\d+\s*:\s*", ""),
    (r"요구\s*사항\s*(?:고유번호|상세설명)?\s*[:：]?\s*", ""),
    (r"세부\s*내용\s*[:：]?\s*", ""),
    (r"\b(?:상세\s*설명|세부\s*내용)\b\s*,?\s*", ""),
    (r"\[\s*(\d{4})\s*\[\s*\1", r"[$1"),
    (r"(\S+)\s+\1(\s+\1)+", r"$1"),
    (r"[ᄀ-ᇿ]+", ""),
    (r",\s*,+", ", "),
    (r"^[,;:]+\s*", ""),
    (r"\s{2,}", " "),
]
NOISE_METADATA_WORDS = [
    "사업명", "사 업 명", "공고번호", "공고 번호", "발주기관", "발주 기관", "입찰마감", "입찰 마감", "과업명",
    "용역명", "파일명", "파일 형식", "사업 요약", "사업 개요", "추진배경", "기대효과",
]
NOISE_PREFIXES = [
    "파일명", "사업명", "공고 번호", "공개 일자", "기본 정보", "원본 문서 정보", "파일 정보", "페이지",
    "□ 사업명", "○ 사업명", "가. 사업명", "나. 사업명",
]
NOISE_LABEL_PATTERN = r"^(파일명|파일 형식|사업 요약|사업 개요|추진배경|기대효과)\s*[:：]"
NOISE_WIDE_WORDS = ["제안서", "제출", "목차"]
INCOMPLETE_MEDIA_PATTERN = r"(?i)(?:\bCD\b|\bDVD\b|\bUSB\b|파일|문서|자료)$"
INCOMPLETE_ENDINGS_PATTERN = (
    r"(하는|이며|하고|하여|되는|발생하는|경우|때|또는|및|으로|와|과|에서|에게|관련|대해)$"
)
COMPLETE_ENDINGS = ["…", "...", ".", "!", "?", "다", "다.", "입니다.", "합니다.", "됨.", "함."]

# ---------------------------------------------------------------- query hardness and heuristics
ORG_SUFFIX_PATTERN = (
    r"(공사|공단|재단|재단법인|사단법인|법인|대학교|대학|병원|의료원|정보원|진흥원|연구원|협회|위원회|조직위원회"
    r"|사무국|센터|서비스|은행|공항|학교)$"
)
ORG_PREFIXES = ["한국", "국립", "국가", "재단법인", "사단법인", "(재)", "(사)"]
COMPLEX_QUERY_PATTERN = (
    r"(비교|차이|각각|동시에|모두|종합|근거|영향|설명해|설명하시오|어떻게\s*다른|무엇이며|요구사항)"
)
FACTOID_QUERY_PATTERN = (
    r"(얼마|금액|예산|사업비|비율|퍼센트|마감|일자|날짜|언제|기간|개월|며칠|문의처|연락처|전화)"
)
CONNECTOR_PATTERN = r"(그리고|또한|및|또는|아울러|동시에)"
ORIGINAL_PRIORITY_WORDS = [
    "사업비", "총사업비", "예산", "금액", "부가가치세",
    "저작권", "라이선스", "사용권", "책임", "부담", "지적재산", "이미지", "글꼴",
    "요구사항", "평가기준", "제안요청", "과업", "조항", "문구", "근거", "표",
    "단위", "수량", "주기", "횟수", "자주", "기한", "복구", "용량", "가이드",
]
BUDGET_HARD_WORDS = ["사업비", "총사업비", "사 업 비", "사업 금액", "부가가치세"]
BUDGET_AMOUNT_WORDS = ["얼마", "금액은", "금액이", "예산"]
BUDGET_TOPIC_PATTERN = r"예산\s*(은|는|이|가|규모|금액|얼마)"
ACCURACY_MODES = ["accurate", "quality", "high_accuracy", "high-accuracy"]
PRECISION_CODE_PATTERN = r"(?i)[a-z]{2,5}\s*[-_ ]?\s*\d{2,3}"
PRECISION_WORDS = [
    "복구", "장애", "문자셋", "인코딩", "utf", "charset",
    "용량", "mb", "gb", "kb", "단위", "수량",
    "직무교육", "핵심투입인력", "핵심 인력", "사업관리자", "pm",
    "가이드", "guideline", "guide",
    "가용성", "무중단", "요구사항", "요건",
    "규격", "치수", "가로", "세로", "도면", "mm",
    "cpu", "xeon", "ghz", "core", "사양",
    "협상적격", "배점한도", "85%",
]
OWNER_RIGHTS = "(저작권|지식재산|지적재산|소유권|귀속|라이선스|사용권)"
OWNER_DUTIES = "(부담|책임|주체|귀속|의무|제안사|사업자|주사업자|계약상대자|발주기관)"
OWNER_GAP = ".{0,48}"
BUDGET_EVIDENCE_WORDS = ["사업비", "총사업비", "예산", "사업 금액", "사 업 비", "금액"]
BUDGET_VALUE_PATTERN = r"(?i)(금\s*)?\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:천원|백만원|만원|억원|원)"
COMPARE_PATTERN = "비교(?!과)"
COMPARE_STRONG_WORDS = ["차이", "공통", "모두 고려", "동시에", "두 문서", "서로 다른", "어떻게 다른"]
COMPARE_DOC_A_PATTERN = r"(?<![a-z0-9])a\s*문서"
COMPARE_DOC_B_PATTERN = r"(?<![a-z0-9])b\s*문서"
COMPARE_EACH_WORDS = ["각 문서", "기관별", "두 문서"]
MULTI_DOC_WORDS = [
    "사업들과", "사업들", "각 사업", "각각", "동시에", "모두", "목록", "식별", "종합", "추진하는 사업 중",
]
FRESH_QUERY_WORDS = ["가장", "top", "순위", "랭킹", "기관 찾아", "관련 사업", "어떤 것이", "추천", "목록"]
FOLLOW_UP_SLOTS = [
    "마감일", "마감", "사업명", "사업비", "예산", "금액", "기한", "기간", "일정", "제출", "요건", "요구사항",
    "담당", "연락처", "주소", "위치", "언제", "얼마", "누가",
]
FOLLOW_UP_ENDINGS = ["?", "요", "줘", "봐", "가요", "인가요"]
PROJECT_WORDS = [
    "시스템", "사업", "구축", "고도화", "용역", "재구축", "개선", "포털", "플랫폼", "조사", "연계", "기능",
]
ORIGINAL_TYPES = ["pdf", "hwp"]
ORIGINAL_WINDOW = 8
EVIDENCE_WINDOW = 12

# ---------------------------------------------------------------- intent
ORG_NAME_ENDINGS = [
    "대학교", "대학", "광역시", "특별시", "특별자치시", "특별자치도", "공사", "연구원", "재단", "공단", "위원회",
    "협회", "진흥원", "기술원", "서비스원", "조직위원회", "사무국", "센터",
]
RANK_NUMBER_PATTERN = r"(top\s*\d+|\d+\s*(?:위|곳|개))"
RANK_STRONG_WORDS = ["top", "순위", "랭킹", "상위", "하위"]
RANK_CONTEXT_WORDS = ["기관", "사업", "곳", "개", "순", "목록", "추천"]
RANK_EXTREME_WORDS = ["가장", "최고", "최저", "많은", "적은", "높은", "낮은", "최대", "최소"]
RANK_WORDS = ["가장", "최고", "최소", "최대", "제일", "top", "ranking", "순위"]
RANK_BLOCKERS = [
    "사양", "cpu", "메모리", "용량", "치수", "규격", "가로", "세로",
    "기한", "마감", "언제", "얼마", "몇", "요구사항", "가이드",
]
RANK_DESC_WORDS = ["많은", "높은", "큰"]
RANK_ASC_WORDS = ["적은", "낮은", "작은"]
RANGE_PATTERNS = [
    r"(\d+\.?\d*)\s*(억|만)\s*(?:에서|부터|~)\s*(\d+\.?\d*)\s*(억|만)",
    r"(\d+\.?\d*)\s*~\s*(\d+\.?\d*)\s*(억|만)",
]
RANGE_WORDS = ["이상", "이하", "초과", "미만", "사이"]
DISCOVERY_WORDS = ["관련 사업", "분야", "기관 찾아", "찾아줘", "추천", "목록", "어떤 것이", "보여줘"]
CATEGORY_WORDS = {
    "IT": ["it", "정보시스템", "디지털", "ai", "데이터", "클라우드", "플랫폼"],
    "교육": ["교육", "대학", "학사"],
}
SEARCH_SLOT_WORDS = [
    "마감", "마감일", "사업명", "사업비", "예산", "금액", "기한",
    "기간", "일정", "언제", "얼마", "누가", "요건", "요구사항",
]
CONFLICT_RANK_PATTERN = r"(top\s*\d+|\d+\s*(위|곳|개)|순위|랭킹|상위|하위|가장)"
CONFLICT_RANGE_PATTERN = r"(이상|이하|초과|미만|사이|부터|~|범위)"
CONFLICT_CATEGORY_WORDS = ["관련 사업", "분야", "추천", "목록", "기관 찾아"]
CONFLICT_ORG_PATTERN = r"[가-힣]+(대학교|대학|공사|공단|재단|위원회|연구원|진흥원|협회|센터)"
CONFLICT_FACT_WORDS = ["얼마", "언제", "마감", "기한", "요구사항", "요건", "누가"]
INTENT_TYPES = ["org", "ranking", "filter", "category", "search"]
SIGNATURE_STOPWORDS = [
    "알려줘", "알려주세요", "알려", "요약", "정리", "설명", "질문", "문서", "기준",
    "이거", "그거", "그것", "해주세요", "해줘", "좀", "관련", "정보",
]
INTENT_CONFIDENCE_REVIEW = 0.78
SEARCH_CONFIDENCE_REVIEW = 0.82
MODEL_MIN_CONFIDENCE = 0.7
MODEL_MARGIN = 0.03
MODEL_DEFAULT_CONFIDENCE = 0.75

# ---------------------------------------------------------------- question plan
PLAN_COMPARE_WORDS = ["차이", "공통", "모두 고려", "동시에", "두 문서"]
PLAN_COMPARE_EACH_WORDS = ["두 문서", "각 문서", "기관별", "a 문서", "b 문서"]
PLAN_OWNER_WORDS = ["누가", "부담", "책임", "소유권", "귀속"]
PLAN_DEADLINE_WORDS = ["언제", "마감", "기한", "이내", "시간", "주기", "횟수"]
PLAN_NUMERIC_WORDS = ["얼마", "수량", "단위", "용량", "몇", "비율", "퍼센트"]
PLAN_MULTI_WORDS = ["둘 다", "복수"]
PLAN_MULTI_PATTERNS = [
    r"[가-힣a-z0-9]{2,}\s*(및|또는)\s*[가-힣a-z0-9]{2,}",
    r"[가-힣a-z0-9]{2,}(와|과)\s+[가-힣a-z0-9]{2,}",
]
PLAN_SLOTS = {
    "comparison": ["docA_claim", "docB_claim", "comparison_point"],
    "owner": ["owner", "evidence"],
    "deadline": ["value", "unit", "evidence"],
    "fact_numeric": ["value", "unit", "evidence"],
    "multi_doc": ["key_points", "evidence"],
    "single_doc": ["key_points", "evidence"],
}
FOLLOW_UP_WORDS = [
    "그거", "그것", "그", "거기", "그곳", "언제", "얼마", "어디", "누구", "더", "또", "다른",
]

# ---------------------------------------------------------------- answers
DESCRIPTIVE_WORDS = [
    "요약", "정리", "설명", "배경", "목적", "개선", "현황", "분석", "절차", "항목", "포함", "비교하여", "비교해서",
    "어떻게 적용",
]
SLOT_UNITS = ["원", "억", "만", "명", "건", "개", "일", "시간", "MB", "GB", "%", "회"]
SLOT_OWNER_WORDS = ["발주", "제안", "수급", "계약상대", "사업자", "주관기관"]
SLOT_DOC_A_WORDS = ["A 문서", "문서 A", "첫 번째"]
SLOT_DOC_B_WORDS = ["B 문서", "문서 B", "두 번째"]
SLOT_COMPARE_WORDS = ["차이", "공통", "반면", "각각", "비교"]
SLOT_KEY_POINTS_LENGTH = 24
UNCERTAIN_SIGNALS = [
    "문서에 명시되어 있지", "찾지 못했", "확인되지 않", "단정할 수 없", "직접 명시한 조항을 찾지 못",
    "명시적 언급이 없", "본문 미제공", "첨부된 hwp", "파일 본문 텍스트가 전달되지",
    "원문(또는 해당 조항 텍스트)을 붙여",
]
DRAFT_STOP_TOKENS = [
    "문서", "기준", "관련", "질문", "답변", "다음", "있습니다", "합니다", "대한", "사업", "내용", "확인", "요약",
    "개요", "배경", "범위", "효과", "목표",
]
BODY_CHECK_WORDS = ["본문", "원문", "조항", "근거", "페이지"]
FINAL_ANSWER_TAGS = ["## 최종 답변:", "최종 답변:"]
BRACKET_ONLY_PATTERN = r"^\[[^\]]+\]$"
SOURCE_LABEL_PATTERN = r"(?i)^(근거|출처|source)\s*[:：]?$"
NUMBERED_FILE_PATTERN = r"^#?\d+\s+.+\.(pdf|hwp|docx?)\b"
ANSWER_LABEL_PATTERN = (
    r"(?i)^(?:핵심\s*결론|결론|요약|핵심\s*답변|근거\s*요약|설명|핵심\s*포인트|가이드)\s*[:：]\s*"
)
ANSWER_LABEL_ONLY_PATTERN = (
    r"(?i)^(근거|출처|source|핵심\s*결론|결론|요약|핵심\s*답변|근거\s*요약|설명|핵심\s*포인트|가이드)\s*[:：]?$"
)
SECTION_NAMES_PATTERN = r"(핵심 답변|근거 요약|근거|출처)"
NO_ANSWER = "요청하신 항목은 문서에서 확인되지 않습니다."
SOURCE_FILE_PATTERN = r"\.(pdf|hwp|hwpx|docx?|xlsx?|csv)\b"
NUMERIC_MARKER_PATTERN = (
    r"(?i)\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:%|원|만원|억원|명|건|개|회|시간|일|주|개월|년|MB|GB|KB)?"
)
SOFTENED_PHRASES = [
    ("문서 기준으로 ", ""),
    ("문서 기준으로", ""),
    ("문서 기준 ", ""),
    ("문서 기준", ""),
    ("관련 직접 근거는", "관련 근거는"),
    ("직접 근거 문구는", "근거 문구는"),
    ("직접 근거(예산/금액 표기)", "근거(예산/금액 표기)"),
    ("단정 답변을 생략합니다.", "단정하지 않겠습니다."),
]
CONTEXT_MARKERS = ["경우", "다만", "단 ", "단,", "예외", "초과", "협의", "허용", "가능"]
CONTINUATION_STARTS = ["경우", "이 경우", "으로", "로", "및", "또는", "단", "다만"]
HONORIFIC_PHRASES = [
    ("할수있음", "할 수 있습니다"),
    ("할수 있음", "할 수 있습니다"),
    ("할 수 있음", "할 수 있습니다"),
    ("조정함", "조정합니다"),
    ("가능함", "가능합니다"),
    ("확인됨", "확인됩니다"),
]
HONORIFIC_CONNECTIVES = [("하며", "합니다"), ("이며", "입니다"), ("이고", "입니다")]
HONORIFIC_ENDINGS_PATTERN = (
    r"(습니다|입니다|합니다|됩니다|있습니다|없습니다|하세요|해 주세요)[.!?]?$"
)
SUMMARY_KEYWORDS_PATTERN = (
    r"(사업|구축|개선|개발|운영|지원|도입|연계|고도화|평가|분석|시스템|플랫폼|데이터|보안|일정|성과|목표|범위)"
)
SUMMARY_SPLIT_PATTERN = r"(?<=[.!?。？！])\s+|[;；]\s+|\s+\|\s+|\s+·\s+"
CLAUSE_SPLIT_PATTERN = r",\s*|\s+및\s+|\s+그리고\s+|\s*/\s*"

# ---------------------------------------------------------------- label synchronisation
LABEL_STOPWORDS = [
    "사업", "시스템", "구축", "기능", "개선", "용역", "관련", "정보", "기관", "기준", "대한", "및", "에서",
    "what", "which", "where", "when", "with", "for", "the", "and", "of",
]
LABEL_TOKEN_PATTERN = r"[0-9A-Za-z가-힣]+"
LABEL_NUMBER_PATTERN = r"\d[\d,]*(?:\.\d+)?"
LABEL_GUIDE_QUESTION = ["가이드", "guideline", "guide", "economic analysis", "cost-benefit"]
LABEL_GUIDE_TEXT = ["guideline", "guide to", "guidelines for", "adb", "european commission"]
LABEL_SIZE_QUESTION = ["치수", "규격", "가로", "세로", "도면", "mm", "분할"]
LABEL_SIZE_TEXT = ["도면", "평면도", "가운데 문", "최소규격", "최대규격"]
LABEL_SIZE_PATTERN = r"\d[\d,]*\s*/\s*\d[\d,]*\s*/\s*\d[\d,]*"

# ---------------------------------------------------------------- evaluation
JUDGE_CRITERIA = ["correctness", "answer_coverage", "faithfulness", "context_relevance"]
LATENCY_STAGES = ["analyze_query", "retrieve", "generate"]
EVAL_TYPE_WEIGHTS = {"single_doc": 0.6, "multi_doc": 0.2, "comparison": 0.2}
RUN_SUMMARY_COLUMNS = [
    "file", "status", "duration_sec", "chunk_count", "sparse_count", "dense_count", "hierarchy_count",
    "reindexed", "error",
]

# Diversity search: candidates per question, weight of the similarity to the question.
DIVERSE_FETCH = 20
DIVERSE_WEIGHT = 0.5
