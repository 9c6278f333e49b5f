"""The governance-form preset: layouts, weights, codes, patterns and wording.

Everything here is data.  Operators take these values as arguments, so another
set of forms needs another preset, not other code.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Sheet names, cell positions, code tables, thresholds, patterns
# and message wording.  They must stay exactly as they are for results to be
# the expected ones.
# --------------------------------------------------------------------------

# --- file kinds ---
EXCEL_SUFFIXES = [".xlsx", ".xlsm", ".xltx", ".xltm"]
KIND_LABELS = {
    "f01": "F01 系統資訊表",
    "f02": "F02 風險評鑑",
    "f03": "F03 上線檢核表",
    "supporting": "佐證文件",
    "unknown": "無法辨識",
}
MAX_FILE_BYTES = 50 * 1024 * 1024

# --- sheets ---
ASSESS_SHEET = "AI系統固有風險分級評估表"
REFERENCE_SHEET = "固有風險分數參照表"
RESIDUAL_SHEET = "AI系統剩餘風險評鑑表"
TREATMENT_SHEET = "AI系統風險處理計畫表"
F01_SHEET = "AI系統業務與利害關係人"
F03_SHEET = "檢核表"
# (kind, sheet, priority, reason); the lowest priority number wins
SIGNATURES = [
    ("f02", ASSESS_SHEET, 1, "含 F02 評估表分頁「{sheet}」"),
    ("f01", F01_SHEET, 2, "含 F01 主表分頁「{sheet}」"),
    ("f03", F03_SHEET, 3, "含 F03 檢核表分頁「{sheet}」"),
]
# sheets a form cannot be read without, with the error text if one is absent
EXPECTED_SHEETS = {
    "f01": [(F01_SHEET, f"'Worksheet {F01_SHEET} does not exist.'")],
    "f02": [
        (ASSESS_SHEET, f"'Worksheet {ASSESS_SHEET} does not exist.'"),
        (RESIDUAL_SHEET, f"Worksheet named '{RESIDUAL_SHEET}' not found"),
        (TREATMENT_SHEET, f"'Worksheet {TREATMENT_SHEET} does not exist.'"),
    ],
}
REASON_SUPPORTING = "非 Excel 檔，視為佐證文件"
REASON_UNREADABLE = "無法開啟（{error}）"
REASON_UNKNOWN = "Excel 但無任何已知表單分頁（分頁：{sheets}）"
NO_SHEETS = "（無分頁）"

# --- F01 layout ---
F01_START_ROW = 4
F01_COLUMNS = {
    "A": "filing_unit",
    "B": "filer",
    "C": "filing_date",
    "D": "project_name",
    "E": "ai_usage",
    "F": "affected_system_name",
    "G": "affected_system_code",
    "H": "system_owner",
    "I": "ap_owner",
    "J": "ai_app_type",
    "K": "business_goal",
    "L": "tech_type",
}
F01_REQUIRED = [
    ("A", "填表單位"),
    ("B", "填表人"),
    ("C", "填表日期"),
    ("D", "專案/服務名稱"),
    ("E", "AI系統運用"),
    ("F", "影響系統名稱"),
    ("G", "影響系統代碼"),
    ("H", "System Owner"),
    ("I", "AP Owner"),
]
# (sheet, column, first data row)
F01_SUB_SHEETS = [("資料", "AB", 4), ("模型", "R", 4), ("平台", "I", 3)]
F01_PLACEHOLDERS = ["對應前頁填寫", "無需填寫"]

# --- F02 layout ---
# (name, sheet, row, column)
F02_FIXED_CELLS = [
    ("factor1", ASSESS_SHEET, 42, "C"),
    ("factor2", ASSESS_SHEET, 43, "C"),
    ("factor3", ASSESS_SHEET, 44, "C"),
    ("finance", ASSESS_SHEET, 46, "E"),
    ("operation", ASSESS_SHEET, 46, "F"),
    ("reputation", ASSESS_SHEET, 46, "G"),
    ("compliance", ASSESS_SHEET, 46, "H"),
    ("overall", ASSESS_SHEET, 2, "I"),
    ("grade", ASSESS_SHEET, 4, "I"),
    ("filing_unit", TREATMENT_SHEET, 2, "N"),
]
RESIDUAL_SCORE_HEADER = "剩餘風險 評鑑分數"
F02_QUESTION_ROWS = (2, 46)
WEIGHT_FORMULA = r'IF\(\$C\d+="([YN])",\s*固有風險分數參照表!T\$(\d+)'
FACTOR_FORMULA = r"固有風險分數參照表!\$T\$(\d+)"
REFERENCE_COLUMNS = {"T": "finance", "U": "operation", "V": "reputation", "W": "compliance"}
DENOMINATOR_ROW = 66

# --- F03 layout ---
F03_OWNER_CELL = (1, "B")
F03_OWNER_PLACEHOLDERS = ["XXX"]
F03_START_ROW = 5
F03_TEMPLATE_ROWS = 30
F03_ITEM_PATTERN = r"^\d+-\d+"
F03_COLUMNS = {
    "A": "item_id",
    "B": "lifecycle",
    "C": "topic",
    "D": "description",
    "F": "mark_yes",
    "G": "mark_no",
    "H": "mark_na",
    "I": "evidence_proposal",
    "J": "evidence_golive",
    "L": "regulation_ref_raw",
}
CHECK_LABELS = {"mark_yes": "是", "mark_no": "否", "mark_na": "不適用"}
UNMARKED_TOKENS = ["false", "0", "none"]
DONE_LABEL = "是"

# --- F02 scoring ---
DOMAINS = ["finance", "operation", "reputation", "compliance"]
DOMAIN_LABELS = {"finance": "財務", "operation": "作業", "reputation": "商譽", "compliance": "合規"}
DENOMINATORS = {"finance": 9.0, "operation": 16.0, "reputation": 13.5, "compliance": 9.0}
GRADES = [(50.0, "低"), (75.0, "中"), (None, "高")]
UPLIFT_FACTORS = {"factor1": 0.8, "factor2": 0.8, "factor3": 1.2}
SINGLE_CHOICE = {"UC-04": 4, "UC-05": 4, "UC-06": 3, "D-01": 4, "M-03": 2}
MULTI_CHOICE = {"D-02": 4}
GENERAL_QUESTIONS = ["UC-01", "UC-02", "UC-03", "UC-07", "D-03", "D-04", "M-01", "M-02"]
# question id, answer that scores, then finance, operation, reputation, compliance
QUESTIONS = [
    ("UC-01", "Y", 1, 0, 2, 1),
    ("UC-02", "Y", 0, 2, 2, 2),
    ("UC-03", "Y", 0, 2, 0, 2),
    ("UC-04-01", "Y", 2, 2, 2, 0),
    ("UC-04-02", "Y", 1.5, 1.5, 1.5, 0),
    ("UC-04-03", "Y", 1, 1, 1, 0),
    ("UC-04-04", "Y", 0, 0, 0, 0),
    ("UC-05-01", "Y", 2, 2, 2, 0),
    ("UC-05-02", "Y", 1.5, 1.5, 1.5, 0),
    ("UC-05-03", "Y", 1, 1, 1, 0),
    ("UC-05-04", "Y", 0, 0, 0, 0),
    ("UC-06-01", "Y", 1.5, 2, 1.5, 0),
    ("UC-06-02", "Y", 1, 1.5, 1, 0),
    ("UC-06-03", "Y", 0, 1, 0, 0),
    ("UC-07", "N", 0, 0.5, 1, 2),
    ("D-01-01", "Y", 1.5, 0, 2, 2),
    ("D-01-02", "Y", 1, 0, 1.5, 1.5),
    ("D-01-03", "Y", 0, 0, 1, 1),
    ("D-01-04", "Y", 0, 0, 0, 0),
    ("D-02-01", "Y", 0, 2, 1, 1),
    ("D-02-02", "Y", 0, 1, 1, 2),
    ("D-02-03", "Y", 0, 2, 1, 2),
    ("D-02-04", "Y", 0, 1.5, 0, 1.5),
    ("D-03", "Y", 1, 2, 0, 0),
    ("D-04", "N", 0.5, 1, 0.5, 2),
    ("M-01", "N", 0, 1, 0, 0),
    ("M-02", "N", 0, 1, 0, 0),
    ("M-03-01", "Y", 0, 0, 0, 0),
    ("M-03-02", "Y", 0, 0, 1, 0),
]
SCORE_TOLERANCE = 0.5
TREATMENT_THRESHOLD = 6
FOLLOW_UP_GRADES = ["中", "高"]

# --- required and conditional documents ---
REQUIRED_DOCS = [
    ("f01", "DOC.MISSING_F01", "F01 AI系統資訊表"),
    ("f03", "DOC.MISSING_F03", "F03 上線檢核表"),
]
SOFT_DOC = ("f02", "DOC.MISSING_F02", "F02 AI風險評鑑")
# (code, label, grades, keywords)
CONDITIONAL_DOCS = [
    ("DOC.MISSING_R06", "R06 可解釋性說明", ["中", "高"], ["可解釋", "解釋性", "R06"]),
    ("DOC.MISSING_R07", "R07 公平性測試報告/人為監督說明", ["中", "高"], ["公平性", "人為監督", "R07"]),
    ("DOC.MISSING_R05", "R05 受委託機構技術文件（如涉及委外）", ["中", "高"], ["委外", "委託", "R05"]),
]
OWNER_COMPARISON = "System Owner（F01.H ↔ F03 系統擁有者）"
UNIT_COMPARISON = "填表單位（F01.A ↔ F02 風險處理計畫表）"

# --- regulation text ---
REGULATIONS = {
    "R01": "article",
    "R02": "chapter",
    "R03": "chapter",
    "R04": "chapter",
    "R05": "chapter",
    "R06": "chapter",
    "R07": "chapter",
}
PAGE_NUMBER_PATTERNS = [
    r"^-?\s*\d+\s*-?$",
    r"^第\s*\d+\s*頁$",
    r"^\d+\s*/\s*\d+$",
]
HEADING_TOKENS = [
    r"^第[一二三四五六七八九十百]+條",
    r"^[一二三四五六七八九十]+、",
    r"^[（(][一二三四五六七八九十]+[）)]",
    r"^\d+[.、]",
]
SENTENCE_TAIL = r"[。：；！？]$"
BOILERPLATE_MIN_PAGES = 3
BOILERPLATE_RATIO = 0.6
ARTICLE_HEAD = r"^(第[一二三四五六七八九十百]+條)[\s　]*(.*)$"
OUTLINE_HEADS = [
    r"^([一二三四五六七八九十]+)、(.*)$",
    r"^[（(]([一二三四五六七八九十]+)[）)](.*)$",
    r"^(\d+)[.、][\s　]*(.*)$",
]
MAX_BODY_CHARS = 800
PURE_TITLE_CHARS = 30
SENTENCE_END = "。"

# --- references ---
REF_SPLIT = r"[\n;]"
REF_HEAD = r"^(R\d{2}(?:[&、]R\d{2})*)"
REF_CODE = r"R\d{2}"
PER_REF_CAP = 3

# --- retrieval ---
SCHEMA_VERSION = 1
EMBED_BATCH = 32
MAX_SECTIONS = 3
EXCERPT_CHARS = 300
SCORE_THRESHOLD = 0.08

# --- judge ---
MAX_ITEMS = 30
EVIDENCE_BATCH = 8
COMPLIANCE_BATCH = 2
BREAKER_RUN = 3
CALLS_PER_COMMIT = 10_000
PROMPT_BUDGET = 6000
VERDICTS = ["covered", "gap", "undetermined"]
NOT_PROVIDED = "（未提供）"
BLANK_EVIDENCE = "（空白）"
DIFF_DEFAULT = "上線階段佐證未清楚列出與提案的差異，請確認。"
VAGUE_DEFAULT = "說明過於空泛或與檢查項目無實質對應，請補充具體佐證。"
DIFF_CELL_DEFAULT = "上線未說明差異"
VAGUE_CELL_DEFAULT = "過於空泛"
CELL_CHARS = 40
CELL_OK = "✅"
CELL_WARN = "🟡"
CELL_FAILED = "⚠️ 判讀失敗"
CELL_EMPTY = "—"
VERDICT_CELLS = {"covered": "✅ 已涵蓋", "gap": "🟡 缺口", "undetermined": "❓ 無法判定"}
EVIDENCE_HEADER = ["項次", "管理議題", "提案↔上線差異", "提案佐證", "上線佐證"]
COMPLIANCE_HEADER = ["項次", "管理議題", "符合性判讀", "條文引用"]

# --- severities and stages ---
SEVERITY_RANK = {"error": 0, "warn": 1, "info": 2}
STAGES = {
    "classify": 0,
    "parse": 1,
    "documents": 2,
    "f01": 3,
    "f02": 4,
    "f03": 5,
    "evidence": 6,
    "compliance": 7,
    "references": 8,
    "cross": 9,
    "ok": 10,
}

# --- report ---
FORM_TYPE = "送件包"
BANNER = "⚠️ 本報告為 AI 初判草稿，需治理人員與三遵人工覆核，最終判定權不在 AI。"
ICONS = {"error": "🔴", "warn": "🟡", "info": "🟢"}
SEVERITY_LABELS = {"error": "錯誤", "warn": "提醒", "info": "通過"}

# --- status matrix ---
ITEM_LOCATION = r"^項次\s*(\d+-\d+)(?:（([^）]*)）)?"
CELL_MARKERS = [("✅", "ok"), ("🟡", "warn"), ("❓", "undet"), ("⚠️", "err")]
AGGREGATE_CODES = ["F03.LLM_TABLE", "F03.LLM_SUMMARY", "F03.RAG_TABLE", "F03.RAG_SUMMARY"]
REG_REF_CODES = ["F02.REG_REF_SUMMARY", "F02.REG_REF_NOTE"]
NOTICE_CODES = ["F03.LLM_SKIPPED", "RAG.SKIPPED", "F03.LLM_ERROR", "F03.RAG_ERROR"]
REFERENCE_BUCKETS = ["aggregate", "regref", "passlog", "all"]
CAUSES = ["golive", "prop", "diff", "rag"]
CAUSE_LABELS = {
    "golive": "上線階段佐證不足",
    "prop": "提案階段佐證不足",
    "diff": "提案與上線差異",
    "rag": "法規符合性缺口",
}
CAUSE_CODES = {
    "F03.EVIDENCE_MISSING_PROPOSAL": "prop",
    "F03.LLM_VAGUE_PROPOSAL": "prop",
    "F03.EVIDENCE_MISSING_GOLIVE": "golive",
    "F03.LLM_VAGUE_GOLIVE": "golive",
    "F03.LLM_DIFF": "diff",
    "F03.RAG_GAP": "rag",
}
FALLBACK_CODES = {"F03.EVIDENCE_MISSING_PROPOSAL": "prop", "F03.EVIDENCE_MISSING_GOLIVE": "golive"}
FALLBACK_NOTE = "空白"
NOTE_PREFIX = r"^(上線階段|提案階段)"
NOTE_STOP = r"[，。；、：].*$"
NOTE_CHARS = 8

# --- finding wording: code -> severity, title, message, location, expected, actual, source ---
FINDINGS = {
    "CLASSIFY.SUMMARY": dict(
        severity="info",
        title="自動分類結果",
        message="共 {n} 個檔案：{lines}。分類依工作表名稱，請人工覆核。",
        location="自動分類",
    ),
    "CLASSIFY.DUPLICATE": dict(
        severity="warn",
        title="偵測到多份 {label}",
        message="有多個檔案判定為 {label}（{both}）；採用第一份「{first}」，請確認「{dup}」是否誤放或為不同送件。",
        location="自動分類",
        expected="每種表單一份",
        actual="{both}",
    ),
    "CLASSIFY.UNRECOGNIZED": dict(
        severity="warn",
        title="無法辨識的 Excel 檔",
        message="檔案「{filename}」是 Excel 但不含任何已知表單分頁，未納入審查。請確認是否為官方範本，或應改列為佐證文件。",
        location="{filename}",
        actual="{reason}",
    ),
    "PARSE_ERROR": dict(
        severity="error",
        title="{form} 解析失敗",
        message="{form} 檔案無法解析（{error}）。請確認檔案為官方範本且未損毀。",
        location="{form}",
        expected="可解析的官方範本",
        actual="解析失敗",
    ),
    "F03.CHECKLIST_PARSE_ERROR": dict(
        severity="error",
        title="F03 檢核項解析失敗",
        message="F03 檢核表的檢核項無法解析（{error}）；識別欄與其他檢查不受影響。",
        location="F03 檢核表",
        expected="可解析的官方範本",
        actual="解析失敗",
    ),
    "DOC.MISSING": dict(
        severity="error",
        title="缺件：{label}",
        message="送件包未包含「{label}」，依規定為必備文件。",
        location="送件包",
        expected="已附 {label}",
        actual="未上傳",
    ),
    "DOC.MISSING_SOFT": dict(
        severity="warn",
        title="缺件：{label}",
        message="送件包未包含「F02 AI風險評鑑」。低風險系統可免；若本案為中/高風險則為必備，且缺 F02 無法判定風險分級，請人工確認。",
        location="送件包",
        expected="中/高風險需附 F02",
        actual="未上傳",
    ),
    "DOC.MISSING_CONDITIONAL": dict(
        severity="warn",
        title="可能缺件：{label}",
        message="本案風險為「{grade}」，依規定可能需附「{label}」；佐證清單未見相關關鍵字（{keywords}），請人工確認是否已提供。",
        location="佐證文件",
        expected="附 {label}",
        actual="佐證清單未見關鍵字",
    ),
    "F01.NO_DATA_ROW": dict(
        severity="error",
        title="F01 主表無任何填寫資料",
        message="F01 系統資訊表主表未偵測到任何 AI 應用資料列（A~L 欄皆空），請確認已填寫。",
        location="主表",
        expected="至少一筆 AI 應用",
        actual="0 筆",
    ),
    "F01.REQUIRED_MISSING": dict(
        severity="error",
        title="主表第 {line} 列有必填欄未填",
        message="主表第 {line} 列必填欄未填：{missing}。",
        location="主表第 {line} 列",
        expected="必填欄皆已填",
        actual="缺 {n} 欄：{missing}",
    ),
    "F02.SERIES_INCOMPLETE": dict(
        severity="error",
        title="{prefix} 系列題有子項未填",
        message="{prefix} 應每個子項都填 Y 或 N，未填：{missing}。",
        location="{prefix}",
        expected="每子項皆 Y/N",
        actual="未填 {n} 項",
    ),
    "F02.GENERAL_INCOMPLETE": dict(
        severity="error",
        title="一般題有未填",
        message="一般題應每題皆填 Y 或 N，未填：{missing}。留空會導致風險分數被低估。",
        location="一般題",
        expected="每題皆 Y/N",
        actual="未填 {n} 題",
    ),
    "F02.SINGLE_CHOICE": dict(
        severity="error",
        title="{prefix} 單選題違規",
        message="{prefix} 為單選題，只能有一個 Y；目前有 {n} 個 Y（{yes}）。",
        location="{prefix}",
        expected="恰 1 個 Y",
        actual="{n} 個 Y",
    ),
    "F02.MULTI_CHOICE": dict(
        severity="error",
        title="{prefix} 複選題未選任何項",
        message="{prefix} 為複選題，至少需有一個 Y，目前全為 N。",
        location="{prefix}",
        expected="≥ 1 個 Y",
        actual="0 個 Y",
    ),
    "F02.CACHE_MISSING": dict(
        severity="warn",
        title="無法比對檔內計分（缺快取值）",
        message="檔內未提供 Excel 已算好的分級/分數（可能由非 Excel 工具產生或未試算），無法與重算比對。重算結果為「{grade}」(分數 {score})，請人工確認。",
        location="分級",
        expected="檔內含 Excel 快取分級",
        actual="無快取",
    ),
    "F02.GRADE_MISMATCH": dict(
        severity="error",
        title="風險分級與重算不一致",
        message="依答案重算分級為「{grade}」(分數 {score})，但檔內為「{stored}」。可能填寫錯誤或公式被改，請人工確認。",
        location="分級",
        expected="重算 {grade}",
        actual="檔內 {stored}",
    ),
    "F02.SCORE_MISMATCH": dict(
        severity="error",
        title="{label}風險分數不一致",
        message="{label}域重算 {computed}%，檔內 {stored}%，差距超過容許值，請人工確認。",
        location="{label}域百分比",
        expected="{computed}%",
        actual="{stored}%",
    ),
    "F02.RESIDUAL_MISSING": dict(
        severity="error",
        title="缺『剩餘風險評鑑表』",
        message="分級為「{grade}」，依規定須續填剩餘風險評鑑表，目前為空。",
        location="AI系統剩餘風險評鑑表",
        expected="已填",
        actual="未填",
    ),
    "F02.RESIDUAL_SCORE_MISSING": dict(
        severity="warn",
        title="剩餘風險分數無法讀取",
        message="剩餘風險評鑑表已填寫，但無法讀取剩餘風險評鑑分數欄，無法判斷是否須續填處理計畫，請人工確認。",
        location="AI系統剩餘風險評鑑表",
        expected="剩餘風險評鑑分數",
        actual="無法讀取",
    ),
    "F02.TREATMENT_MISSING": dict(
        severity="error",
        title="缺『AI系統風險處理計畫表』",
        message="剩餘風險分數 {score} 大於等於 {threshold}，依規定須續填風險處理計畫表，目前為空。",
        location="AI系統風險處理計畫表",
        expected="已填",
        actual="未填",
    ),
    "F02.OK": dict(
        severity="info",
        title="規則檢查未發現問題",
        message="F02 通過所有規則式檢查（缺漏、單複選、系列與一般題完整、計分比對、續填）。仍須人工覆核實質內容。",
    ),
    "F02.REG_REF_NOTE": dict(
        severity="info",
        title="F02 觸發題對應法規條文（{qid}）",
        message="F02 風險題 {qid} 答案為「{answer}」（觸發風險評分），對應法規條文引用：{refs}。請確認相關法規要求已納入管控措施，送治理人員人工覆核。",
        location="{qid}",
    ),
    "F02.REG_REF_SUMMARY": dict(
        severity="info",
        title="F02 法規查表摘要",
        message="F02 法規查表：觸發題 {triggered} 道，共引用 {cited} 條條文；僅供初步參考，請人工覆核。",
    ),
    "F03.EVIDENCE_MISSING_PROPOSAL": dict(
        severity="warn",
        title="已勾選完成，但提案規劃階段佐證空白",
        message="此檢核項勾選「是（已完成檢核）」，卻未填『前項佐證說明(提案規劃階段)』，請補充佐證或確認勾選。",
        location="{loc}",
        expected="提案規劃階段佐證",
        actual="空白",
    ),
    "F03.EVIDENCE_MISSING_GOLIVE": dict(
        severity="info",
        title="上線階段佐證空白",
        message="此檢核項『前項佐證說明(上線階段;列出與提案差異)』空白；上線階段佐證可能於上線前補填，請留意。",
        location="{loc}",
        expected="上線階段佐證（列出與提案差異）",
        actual="空白",
    ),
    "CROSS.MISMATCH": dict(
        severity="warn",
        title="跨表不一致：{label}",
        message="{label} 在兩表對不上，請人工確認是否為同一系統／單位（也可能是簡稱或全半形差異）。",
        location="{label}",
        expected="{left}",
        actual="{right}",
    ),
    "CROSS.F01_INTERNAL_NAME": dict(
        severity="warn",
        title="F01 內部專案名稱對不上（{sheet}）",
        message="「{sheet}」第 {line} 列對應欄「{name}」與主表任一專案/服務名稱（{names}）皆不符，請人工確認。",
        location="主表 / {sheet}第{line}列",
        expected="{names}",
        actual="{name}",
    ),
    "SUBMISSION.OK": dict(
        severity="info",
        title="送件包規則檢查未發現問題",
        message="核心文件齊備、F01 必填完整、F02 規則通過、跨表一致。仍須人工覆核實質內容。",
    ),
    "F03.LLM_DIFF": dict(
        severity="warn", title="提案與上線階段佐證可能存在差異", message="{text}", location="{loc}", source="llm"
    ),
    "F03.LLM_VAGUE_PROPOSAL": dict(
        severity="warn", title="提案規劃階段佐證過於草率/不明確", message="{text}", location="{loc}", source="llm"
    ),
    "F03.LLM_VAGUE_GOLIVE": dict(
        severity="warn", title="上線階段佐證過於草率/不明確", message="{text}", location="{loc}", source="llm"
    ),
    "F03.LLM_ITEM_ERROR": dict(
        severity="info",
        title="單項 LLM 判讀缺漏（已略過）",
        message="LLM 批次回應未涵蓋此項，已略過；其餘項目不受影響。",
        location="{loc}",
        source="llm",
    ),
    "F03.LLM_BATCH_ERROR": dict(
        severity="info",
        title="本批 LLM 判讀失敗（已略過）",
        message="本批 {n} 項 LLM 判讀失敗，已略過續審其餘批次（{locs}）。",
        location="{loc}",
        source="llm",
    ),
    "F03.LLM_ERROR": dict(
        severity="warn",
        title="LLM 佐證審查中止",
        message="連續 {run} 批呼叫 LLM 端點失敗，研判端點異常，已中止；已審 {reviewed} 項，尚有未完成判讀項目。",
        location="{loc}",
        source="llm",
    ),
    "F03.LLM_TABLE": dict(severity="info", title="LLM 佐證審查彙整表", message="{table}", source="llm"),
    "F03.LLM_SUMMARY": dict(
        severity="info",
        title="LLM 佐證審查摘要",
        message="LLM 佐證審查：審閱 {reviewed} 項，標示 {flagged} 項待人工覆核。{notes}",
        source="llm",
    ),
    "F03.LLM_SKIPPED": dict(
        severity="info",
        title="LLM 佐證審查已略過",
        message="無法初始化或執行 LLM 判讀（{error}）；其餘規則檢查不受影響。",
        source="llm",
    ),
    "F03.TEMPLATE_REF_MODIFIED": dict(
        severity="warn",
        title="F03 模板欄位疑似被修改",
        message="項次 {item} 的「規範參考」或「檢查項目描述」與官方模板不符，疑似被提案單位修改；判讀仍以官方模板（canonical）為準，請人工核查。",
        location="{loc}",
        source="llm",
    ),
    "F03.RAG_GAP": dict(
        severity="warn",
        title="佐證與法規條文存在符合性缺口",
        message="佐證未涵蓋下列條文要求：{refs}。請補充佐證後送人工覆核。{reason}",
        location="{loc}",
        source="llm",
    ),
    "F03.RAG_UNDETERMINED": dict(
        severity="info",
        title="佐證符合性無法判定",
        message="無法判定佐證是否涵蓋條文要求，請人工覆核。{reason}",
        location="{loc}",
        source="llm",
    ),
    "F03.RAG_ITEM_ERROR": dict(
        severity="info",
        title="單項 RAG 判讀缺漏（已略過）",
        message="LLM 批次回應未涵蓋此項，已略過；其餘項目不受影響。",
        location="{loc}",
        source="llm",
    ),
    "F03.RAG_BATCH_ERROR": dict(
        severity="info",
        title="本批 RAG 判讀失敗（已略過）",
        message="本批 {n} 項 RAG 符合性判讀失敗，已略過續審其餘批次（{locs}）。",
        location="{loc}",
        source="llm",
    ),
    "F03.RAG_ERROR": dict(
        severity="warn",
        title="RAG 符合性判讀中止",
        message="連續 {run} 批呼叫 LLM 端點失敗，研判端點異常，已中止；已審 {reviewed} 項，尚有未完成判讀項目。",
        location="{loc}",
        source="llm",
    ),
    "F03.RAG_FAILED": dict(
        severity="warn",
        title="RAG 符合性判讀異常中止",
        message="RAG 符合性判讀發生未預期錯誤，已中止；其餘規則檢查不受影響，請人工覆核。",
        source="llm",
    ),
    "F03.RAG_TABLE": dict(severity="info", title="RAG 符合性判讀彙整表", message="{table}", source="llm"),
    "F03.RAG_SUMMARY": dict(
        severity="info",
        title="RAG 符合性判讀摘要",
        message="RAG 符合性判讀：審閱 {reviewed} 項，缺口 {gaps} 項、無法判定 {undetermined} 項，待人工覆核。{notes}",
        source="llm",
    ),
    "RAG.SKIPPED": dict(
        severity="info",
        title="RAG 法規比對已略過",
        message="RAG 法規比對無法執行（{error}），已略過；其餘規則檢查與報告不受影響，請人工覆核。",
    ),
}
# cell texts that a sheet reader takes for empty
MISSING_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
# -------------------------------- end of fixed values -----------------------

# Values of a list that are joined to one text at a time; results do not depend on it.
JOIN_BLOCK = 4096
# Rows per block of a two-level running computation.
SCAN_BLOCK = 65536
