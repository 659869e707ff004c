"""Configuration of the spend engine: column names, status map, taxonomy, rules.

Everything in the block marked FIXED VALUES must stay equal to the values the
studied pipeline ships with, because classification, status mapping and text
output depend on them literally.  They are stated here as plain data, in the
order they are declared there.  A caller may pass their own rule list /
taxonomy / status map to every operator instead (e.g. loaded from YAML with
``load_yaml_config``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference configuration and column contract)
# ---------------------------------------------------------------------------

# The 15 required raw export columns, in declared order.
REQUIRED_COLUMNS = [
    "quarter_period",
    "report_type",
    "quarter_str",
    "year_month_str",
    "year_num",
    "registrator_status_name",
    "bit_stati_oborotov_naimenovanie",
    "bit_stati_oborotov_kodifikator",
    "summa",
    "period",
    "kontragenti_naimenovanie",
    "dogovori_kontragentov_naimenovanie",
    "proekti_naimenovanie",
    "podrazdeleniya_naimenovanie",
    "organizacii_naimenovanie",
]

AMOUNT_COLUMNS = ["summa", "summa_regl", "summa_upr", "summa_vzaimorascheti"]

DATE_COLUMNS = [
    "period",
    "quarter_period",
    "bit_zayavka_na_rashodovanie_sredstv_data",
    "bit_platezhnaya_poziciya_data",
]

# Base-period preference (first existing column wins).
BASE_PERIOD_COLUMNS = [
    "period",
    "bit_platezhnaya_poziciya_data",
    "bit_zayavka_na_rashodovanie_sredstv_data",
    "quarter_period",
]

TEXT_COLUMNS = [
    "bit_stati_oborotov_naimenovanie",
    "naznachenie_platezha",
    "kontragenti_naimenovanie",
    "dogovori_kontragentov_naimenovanie",
]

ENTITY_COLUMNS = [
    "organizacii_naimenovanie",
    "podrazdeleniya_naimenovanie",
    "proekti_naimenovanie",
    "kontragenti_naimenovanie",
]

STATUS_COLUMN = "registrator_status_name"
BUSINESS_STATUS_COLUMN = "business_status"

# Classifier feature columns (rule conditions may only name these).
FEATURE_COLUMNS = [
    "bit_stati_oborotov_naimenovanie",
    "bit_stati_oborotov_kodifikator",
    "naznachenie_platezha",
    "kontragenti_naimenovanie",
    "dogovori_kontragentov_naimenovanie",
    "proekti_naimenovanie",
    "podrazdeleniya_naimenovanie",
    "p_bit_tipi_statei_oborotov_synonim",
    "p_bit_vidi_denezhnih_sredstv_synonim",
]
SUPPORTED_MATCH_TYPES = ["contains_any", "equals_any", "regex_any", "in_list"]

# Evidence tiers: which condition columns count as article / vendor evidence,
# and which text fields feed the keyword tier (with their weights).
ARTICLE_COLUMNS = [
    "bit_stati_oborotov_naimenovanie",
    "bit_stati_oborotov_kodifikator",
    "p_bit_tipi_statei_oborotov_synonim",
    "p_bit_vidi_denezhnih_sredstv_synonim",
]
VENDOR_COLUMNS = ["kontragenti_naimenovanie", "dogovori_kontragentov_naimenovanie"]
KEYWORD_COLUMNS = [
    "bit_stati_oborotov_naimenovanie",
    "naznachenie_platezha",
    "dogovori_kontragentov_naimenovanie",
]
KEYWORD_WEIGHTS = {
    "bit_stati_oborotov_naimenovanie": 0.5,
    "naznachenie_platezha": 0.3,
    "dogovori_kontragentov_naimenovanie": 0.2,
}

# Confidence composition and buckets.
ARTICLE_BONUS = 0.1
VENDOR_BONUS = 0.05
KEYWORD_FACTOR = 0.15
BUCKET_HIGH = 0.85
BUCKET_MEDIUM = 0.65
DEFAULT_REVIEW_REQUIRED_BELOW = 0.75

# Defaults of the fact projection.
FACT_DEFAULT_L1 = "other_it"
FACT_DEFAULT_L2 = "unclassified"
FACT_DEFAULT_L3 = "review_required"
FACT_DEFAULT_CONFIDENCE = "unclassified"

# Years the reporting checks expect (a parameter everywhere).
DEFAULT_REPORTING_YEARS = (2025, 2026)

# Status map: business status -> raw substrings (lower-cased on load).
STATUS_RULES: dict[str, list[str]] = {
    "paid": ["оплачен", "исполнен", "paid", "completed"],
    "approved_not_paid": ["утвержден", "согласован", "approved", "ready for payment"],
    "in_approval": ["на согласовании", "на утверждении", "in approval", "draft"],
    "rejected": ["отклонен", "отменен", "rejected", "cancelled"],
}
STATUS_OTHER = "other"

STATUS_LABELS = {
    "paid": "Оплачено",
    "approved_not_paid": "Согласовано, не оплачено",
    "in_approval": "На согласовании",
    "rejected": "Отклонено",
    "other": "Прочее",
}

# Cyrillic -> Latin transliteration used by column names and slugs.
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e",
    "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "",
    "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}

# Category taxonomy: L1 -> (description, {L2: [L3, ...]}).
TAXONOMY: dict[str, dict[str, Any]] = {
    "infrastructure": {
        "description": "Core infrastructure, hosting, cloud, data platforms, and runtime services.",
        "children": {
            "cloud_and_hosting": ["iaas", "paas", "managed_hosting", "backup_and_storage"],
            "data_platforms": ["databases", "data_warehouse", "observability"],
            "network_and_core_services": [
                "dns_and_domains", "load_balancing", "cdn", "certificate_services",
                "network_infrastructure", "server_infrastructure",
            ],
        },
    },
    "software_and_licenses": {
        "description": "Application software, subscriptions, productivity tools, and software licensing.",
        "children": {
            "business_software": [
                "erp_and_finance", "crm", "document_management", "hr_systems",
                "general_business_software",
            ],
            "engineering_tools": [
                "developer_tools", "devops_tools", "design_tools", "general_software_tools",
            ],
            "productivity_and_collaboration": [
                "office_suites", "knowledge_management", "meeting_tools", "messaging_tools",
            ],
        },
    },
    "development_and_support": {
        "description": "External development work, support contracts, implementation, and managed services.",
        "children": {
            "implementation_and_delivery": [
                "custom_development", "integrations", "qa_and_testing", "migration_projects",
            ],
            "support_services": [
                "application_support", "infrastructure_support", "vendor_support", "consulting",
                "it_outsourcing", "staff_augmentation",
            ],
        },
    },
    "workplace_equipment": {
        "description": "Employee-facing devices, peripherals, workplace setup, and hardware lifecycle costs.",
        "children": {
            "end_user_devices": ["laptops", "desktops", "mobile_devices", "tablets", "workstations"],
            "workplace_accessories": [
                "monitors", "peripherals", "conference_equipment", "printers", "consumables",
                "managed_print_services",
            ],
        },
    },
    "information_security": {
        "description": "Cybersecurity software, services, controls, audit, and compliance-related spend.",
        "children": {
            "security_software": [
                "endpoint_protection", "siem_and_soc", "vulnerability_management", "identity_and_access",
            ],
            "security_services": [
                "audit_and_compliance", "penetration_testing", "awareness_training", "incident_response",
            ],
        },
    },
    "communications": {
        "description": "Connectivity, telephony, communication channels, and related infrastructure.",
        "children": {
            "connectivity": ["internet_access", "data_channels", "vpn", "branch_connectivity"],
            "telephony_and_comms": [
                "mobile_communications", "fixed_line", "virtual_pbx", "sms_and_notifications",
                "unified_communications", "communications_equipment",
            ],
        },
    },
    "other_it": {
        "description": "Residual IT spend that does not yet fit a governed category.",
        "children": {
            "unclassified": ["review_required", "misc_services", "misc_software", "misc_hardware"],
        },
    },
}


def _rule(rule_id, priority, confidence, target, conditions, review_required_below):
    l1, l2, l3 = target
    return {
        "rule_id": rule_id,
        "priority": priority,
        "confidence": confidence,
        "target": {"l1": l1, "l2": l2, "l3": l3},
        "conditions": [
            {"column": column, "match_type": match_type, "values": list(values)}
            for column, match_type, values in conditions
        ],
        "review_required_below": review_required_below,
    }


ART = "bit_stati_oborotov_naimenovanie"
VEN = "kontragenti_naimenovanie"
CON = "dogovori_kontragentov_naimenovanie"
PUR = "naznachenie_platezha"
PRJ = "proekti_naimenovanie"
DEP = "podrazdeleniya_naimenovanie"

# Classification rules in declared order.
CLASSIFICATION_RULES: list[dict[str, Any]] = [
    _rule("infra_cloud_hosting", 10, 0.95, ("infrastructure", "cloud_and_hosting", "managed_hosting"), [
        (ART, "contains_any", ["hosting", "cloud", "infrastructure"]),
        (VEN, "contains_any", ["selectel", "yandex cloud", "vk cloud"]),
    ], 0.8),
    _rule("communications_internet_access_ru", 15, 0.97, ("communications", "connectivity", "internet_access"), [
        (ART, "contains_any", ["стационарные каналы связи и доступ в интернет", "доступ в интернет", "каналы связи"]),
    ], 0.8),
    _rule("dev_support_it_outsourcing_ru", 20, 0.95, ("development_and_support", "support_services", "it_outsourcing"), [
        (ART, "contains_any", ["аутсорсинг ит услуг", "аутсорсинг it услуг", "поддержка it-сервисов", "поддержка it сервисов"]),
    ], 0.8),
    _rule("communications_mobile_ru", 25, 0.97, ("communications", "telephony_and_comms", "mobile_communications"), [
        (ART, "contains_any", ["корпоративная мобильная связь", "мобильная связь"]),
        (VEN, "contains_any", ["вымпелком", "мтс", "мегафон", "скартел", "t2 мобайл"]),
    ], 0.8),
    _rule("software_general_ru", 30, 0.9, ("software_and_licenses", "business_software", "general_business_software"), [
        (ART, "contains_any", ["программное обеспечение", "обновления и подписки для ит оборудования"]),
        (VEN, "contains_any", ["контур", "системный софт", "1с", "билдсофт", "майнд крафт"]),
    ], 0.78),
    _rule("communications_unified_comms_ru", 35, 0.93, ("communications", "telephony_and_comms", "unified_communications"), [
        (ART, "contains_any", ["телефония и унифицированные коммуникации", "унифицированные коммуникации", "телефония"]),
    ], 0.8),
    _rule("dev_support_staff_augmentation_ru", 40, 0.94, ("development_and_support", "support_services", "staff_augmentation"), [
        (ART, "contains_any", ["аутстаффинг управленческие расходы", "аутстаффинг"]),
    ], 0.8),
    _rule("workplace_print_consumables_ru", 45, 0.95, ("workplace_equipment", "workplace_accessories", "consumables"), [
        (ART, "contains_any", ["картриджи и запасные части для мфу и принтеров", "расходные материалы", "картриджи", "запасные части для мфу"]),
    ], 0.8),
    _rule("workplace_managed_print_ru", 50, 0.94, ("workplace_equipment", "workplace_accessories", "managed_print_services"), [
        (ART, "contains_any", ["аутсорс сервиса печати"]),
    ], 0.8),
    _rule("infrastructure_dns_domains_ru", 55, 0.96, ("infrastructure", "network_and_core_services", "dns_and_domains"), [
        (ART, "contains_any", ["оплата хостингов и доменов", "хостингов и доменов", "доменов"]),
        (VEN, "contains_any", ["рсиц", "рег.ру", "masterhost"]),
    ], 0.8),
    _rule("infrastructure_network_buildout_ru", 60, 0.93, ("infrastructure", "network_and_core_services", "network_infrastructure"), [
        (ART, "contains_any", ["кабельные сети и инженерная инфраструктура", "сетевое оборудование", "оборудование связи", "кабельные сети"]),
    ], 0.8),
    _rule("workplace_printers_ru", 65, 0.93, ("workplace_equipment", "workplace_accessories", "printers"), [
        (ART, "contains_any", ["оборудование печати"]),
    ], 0.8),
    _rule("workplace_workstations_ru", 70, 0.93, ("workplace_equipment", "end_user_devices", "workstations"), [
        (ART, "contains_any", ["компьютерное оборудование"]),
    ], 0.8),
    _rule("infrastructure_servers_ru", 75, 0.94, ("infrastructure", "network_and_core_services", "server_infrastructure"), [
        (ART, "contains_any", ["серверное оборудование"]),
    ], 0.8),
    _rule("workplace_conference_equipment_ru", 80, 0.92, ("workplace_equipment", "workplace_accessories", "conference_equipment"), [
        (ART, "contains_any", ["мультимедиа оборудование"]),
    ], 0.8),
    _rule("dev_support_application_support_ru", 85, 0.9, ("development_and_support", "support_services", "application_support"), [
        (ART, "contains_any", ["поддержка it-сервисов", "поддержка it сервисов"]),
    ], 0.8),
    _rule("workplace_misc_consumables_ru", 90, 0.85, ("workplace_equipment", "workplace_accessories", "consumables"), [
        (ART, "contains_any", ["прочие ит расходные материалы"]),
    ], 0.8),
    _rule("licenses_productivity", 100, 0.9, ("software_and_licenses", "productivity_and_collaboration", "office_suites"), [
        (ART, "contains_any", ["microsoft 365", "office", "workspace"]),
        (CON, "contains_any", ["license", "subscription"]),
    ], 0.8),
    _rule("dev_support_outsource", 110, 0.85, ("development_and_support", "implementation_and_delivery", "custom_development"), [
        (PUR, "contains_any", ["development", "implementation", "support"]),
        (PRJ, "contains_any", ["erp", "crm", "integration"]),
    ], 0.75),
    _rule("workplace_laptops", 120, 0.88, ("workplace_equipment", "end_user_devices", "laptops"), [
        (ART, "contains_any", ["laptop", "notebook"]),
        (DEP, "contains_any", ["it", "support"]),
    ], 0.8),
    _rule("security_endpoint", 130, 0.92, ("information_security", "security_software", "endpoint_protection"), [
        (ART, "contains_any", ["antivirus", "endpoint", "edr"]),
        (VEN, "contains_any", ["kaspersky", "positive technologies"]),
    ], 0.85),
    _rule("communications_mobile", 140, 0.9, ("communications", "telephony_and_comms", "mobile_communications"), [
        (ART, "contains_any", ["mobile", "telecom", "telephony"]),
        (VEN, "contains_any", ["mts", "megafon", "beeline"]),
    ], 0.8),
    _rule("fallback_other_it", 999, 0.3, ("other_it", "unclassified", "review_required"), [
        (ART, "in_list", ["*"]),
    ], 0.99),
]

# Unmatched-row result.
UNMATCHED_REASON = "No matching classification rule"
UNMATCHED_REASON_HUMAN = (
    "Категория не определена автоматически: не найдено уверенного совпадения "
    "по статье, поставщику, договору или ключевым словам."
)

# Text templates of the human explanation (placeholders filled per row).
AUDIT_PIPELINE_FIELDS = [
    "business_status", "year", "month", "quarter", "year_month", "l1_category", "l2_category", "l3_category",
    "classification_confidence", "classification_confidence_score", "matched_rule_id", "matched_keywords",
    "matched_vendor_pattern", "matched_article_pattern", "classification_reason_human",
]
AUDIT_DERIVED_FIELDS = ["year", "month", "quarter", "year_month"]
AUDIT_FIELD_RULES = [
    ("amount_numeric_parse", "Парсинг числовой суммы"),
    ("date_normalization", "Нормализация даты"),
    ("text_cleanup", "Нормализация текстового поля"),
    ("entity_normalization", "Нормализация справочника сущностей"),
]
AUDIT_STATUS_RULE = ("status_mapping", "Маппинг статуса в бизнес-статус")
AUDIT_DERIVED_RULE = ("date_derived_fields", "Расчет производных полей отчетного периода")
HUMAN_RULE = "Применено правило {rule_id}."
HUMAN_ARTICLE = "Совпала статья или код с шаблоном '{pattern}'."
HUMAN_VENDOR = "Совпал поставщик или договор с шаблоном '{pattern}'."
HUMAN_KEYWORDS = "Дополнительно сработали ключевые слова: {keywords}."
HUMAN_TARGET = "Запись отнесена в категорию {l1} / {l2} / {l3}."

# Review queue output columns.
REVIEW_COLUMNS = [
    "raw_article",
    "raw_description",
    "raw_vendor",
    "suggested_l1",
    "suggested_l2",
    "suggested_l3",
    "confidence",
    "reason",
]

# Payments fact column order.
FACT_COLUMNS = [
    "payment_id",
    "period_date",
    "year",
    "month",
    "quarter",
    "amount",
    "status_raw",
    "status_group",
    "article_name",
    "article_code",
    "vendor_name",
    "contract_name",
    "project_name",
    "department_name",
    "organization_name",
    "l1_category",
    "l2_category",
    "l3_category",
    "classification_confidence",
    "matched_rule_id",
    "matched_keywords",
    "matched_vendor_pattern",
    "matched_article_pattern",
    "classification_reason_human",
]

# Columns whose stripped values form the payment content hash, in order.
PAYMENT_ID_COLUMNS = [
    "period",
    "summa",
    "bit_stati_oborotov_naimenovanie",
    "kontragenti_naimenovanie",
    "dogovori_kontragentov_naimenovanie",
    "proekti_naimenovanie",
    "podrazdeleniya_naimenovanie",
    "organizacii_naimenovanie",
]

# QA defaults.
QA_REQUIRED_FACT_FIELDS = [
    "payment_id",
    "period_date",
    "year",
    "amount",
    "status_group",
    "vendor_name",
    "organization_name",
    "l1_category",
    "classification_confidence",
]
QA_MAX_NULL_SHARE = 0.2
QA_MIN_PARSE_RATE = 0.99
QA_MIN_STATUS_COVERAGE = 0.95
QA_MIN_CLASSIFICATION_COVERAGE = 0.8

# Insight titles and severity order.
SEVERITY_RANK = {"critical": 0, "warning": 1, "info": 2}
UNPAID_STATUSES = ["approved_not_paid", "in_approval"]

# Dashboard constants.
DASHBOARD_TITLE = "Дашборд расходов IT-департамента"
DASHBOARD_CURRENCY = "RUB"
DETAIL_PAGE_SIZE = 10

# Insight titles and texts.
TITLE_TOP_CATEGORY = "Крупнейшая категория расходов"
TITLE_YOY = "Рост расходов год к году"
TITLE_BOTTLENECK = "Статусные узкие места"
TITLE_VENDOR = "Концентрация на поставщиках"
TITLE_UNPAID = "Крупные неоплаченные позиции"
TITLE_UNCATEGORIZED = "Доля неклассифицированных расходов"
TITLE_ANOMALY = "Потенциальные аномалии"
EMPTY_INSIGHT_TEXT = "Недостаточно данных для формирования управленческого вывода."
BOTTLENECK_EMPTY_TEXT = "Существенных зависших сумм в статусах согласования и ожидания оплаты не выявлено."
UNPAID_EMPTY_TEXT = "Крупные неоплаченные позиции не обнаружены."
ANOMALY_EMPTY_TEXT = "Выраженных аномалий по суммам внутри категорий не выявлено."
ZERO_THOUSANDS = "0,00 тыс. руб."
NEW_CATEGORY_TEXT = "новая категория расходов"
# Thresholds of the insight severities.
TOP_CATEGORY_WARNING_SHARE = 0.35
YOY_CRITICAL_GROWTH = 0.5
VENDOR_CRITICAL_SHARE = 0.5
VENDOR_WARNING_SHARE = 0.3
UNPAID_CRITICAL_MEDIAN_FACTOR = 2.0
UNCATEGORIZED_CRITICAL_SHARE = 0.2
UNCATEGORIZED_WARNING_SHARE = 0.1
ANOMALY_MIN_ROWS = 4
ANOMALY_IQR_FACTOR = 1.5
INSIGHT_LIMIT = 5

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class EngineConfig:
    """Bundle of configuration objects passed to the operators."""

    rules: list[dict[str, Any]] = field(default_factory=lambda: CLASSIFICATION_RULES)
    taxonomy: dict[str, dict[str, Any]] = field(default_factory=lambda: TAXONOMY)
    statuses: dict[str, list[str]] = field(default_factory=lambda: STATUS_RULES)


DEFAULT_CONFIG = EngineConfig()


def load_yaml_config(config_dir: str | Path) -> EngineConfig:
    """Read the three YAML files (statuses, taxonomy, rules) of a config folder.

    The files are tiny; they are read on the driver once and turned into plan
    literals / broadcast tables by the operators.
    """
    import yaml  # optional dependency

    base = Path(config_dir)

    def read(name: str) -> dict[str, Any]:
        path = base / name
        if not path.exists():
            return {}
        with path.open("r", encoding="utf-8") as handle:
            return yaml.safe_load(handle) or {}

    statuses_raw = read("statuses.yaml")
    taxonomy_raw = read("category_taxonomy.yaml")
    rules_raw = read("classification_rules.yaml")
    statuses = (
        {str(k): [str(v).lower() for v in values] for k, values in statuses_raw.items()}
        if statuses_raw
        else STATUS_RULES
    )
    taxonomy = taxonomy_raw.get("taxonomy", TAXONOMY) if taxonomy_raw else TAXONOMY
    rules = rules_raw.get("rules", CLASSIFICATION_RULES) if rules_raw else CLASSIFICATION_RULES
    return EngineConfig(rules=list(rules), taxonomy=dict(taxonomy), statuses=statuses)
