"""Default settings. Everything here is a parameter of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: category slugs and labels ---------------------------------
CATEGORIES = {
    "economia": "Economia",
    "politica": "Politica",
    "deportes": "Deportes",
    "tecnologia": "Tecnologia",
    "entretenimiento": "Entretenimiento",
    "policiales": "Policiales",
    "clima": "Clima",
    "mundo": "Mundo",
    "salud": "Salud",
    "sociedad": "Sociedad",
    "general": "General",
}

# --- fixed values: free-text category names -> slug --------------------------
CATEGORY_ALIASES = {
    "economia y finanzas": "economia",
    "economicas": "economia",
    "economico": "economia",
    "politica nacional": "politica",
    "nacional": "politica",
    "nacionales": "politica",
    "seguridad": "policiales",
    "policial": "policiales",
    "policia": "policiales",
    "crimen": "policiales",
    "futbol": "deportes",
    "deporte": "deportes",
    "tech": "tecnologia",
    "tecnologia e innovacion": "tecnologia",
    "cultura": "entretenimiento",
    "espectaculos": "entretenimiento",
    "tiempo": "clima",
    "meteorologia": "clima",
    "internacional": "mundo",
    "internacionales": "mundo",
    "ciencia": "salud",
}

# --- fixed values: title prefixes without content ----------------------------
LOW_VALUE_PREFIXES = ("video", "ultima hora", "ultimo momento", "en vivo", "envivo")

# --- fixed values: words ignored when comparing stories ----------------------
STORY_STOPWORDS = (
    "para", "como", "esta", "este", "esto", "desde", "sobre", "entre", "tras", "ante",
    "bolivia", "noticia", "informa",
)
CORROBORATION_STOPWORDS = (
    "para", "como", "esta", "este", "esto", "desde", "sobre", "entre", "tras", "ante",
    "bolivia",
)

# --- fixed values: URL parameters that do not identify an article ------------
TRACKING_PREFIXES = ("utm_",)
TRACKING_KEYS = (
    "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid",
    "ref_src", "ref", "yclid", "twclid", "spm", "_ga", "mkt_tok", "cmpid", "amp",
)

# --- fixed values: URL fragments of pages that are not articles --------------
NON_ARTICLE_URL_FRAGMENTS = (
    "/tag/", "/category/", "/categoria/", "/author/", "/el-toque-de-la-abuela", "/page/",
    "/programa/", "/programacion/", "/politicas-privacidad", "/politicas-de-privacidad",
    "/politica-de-privacidad", "/santa-cruz", "/terminos-condiciones",
    "/terminos-y-condiciones", "facebook.com", "instagram.com", "twitter.com",
    "youtube.com", "tiktok.com",
)

# --- fixed values: image URLs that are not article pictures ------------------
TRACKER_IMAGE_FRAGMENTS = ("tracker.metricool.com", "/c3po.jpg", "pixel", "tracker", "analytics")
DECORATION_IMAGE_FRAGMENTS = ("logo", "favicon", "icon", "placeholder", "avatar")

# --- fixed values: lines that end an article body ----------------------------
BODY_STOP_MARKERS = (
    "recibe las noticias", "ultimas noticias", "últimas noticias", "siga unitel",
    "sobre unitel", "noticias relacionadas", "comentarios", "mas leidas", "más leídas",
    "mas noticias", "más noticias", "programacion", "programación", "temas relacionados",
    "seguinos en", "terminos y condiciones", "términos y condiciones",
    "politica de privacidad", "política de privacidad", "tambien te puede interesar",
    "también te puede interesar", "te puede interesar",
)
# --- fixed values: lines skipped inside an article body ----------------------
BODY_NOISE_MARKERS = (
    "facebook", "twitter", "whatsapp", "instagram", "tiktok", "publicacion:",
    "publicación:", "unitel digital", "mira aqui", "mira aquí", "te puede interesar",
    "direccion de correo", "dirección de correo", "indica que es obligatorio",
    "real people should not fill", "publicidad", "escuchar esta nota",
    "mira la programacion", "mira la programación",
)

# --- fixed values: month names -----------------------------------------------
MONTHS_ES = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7,
    "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11,
    "diciembre": 12,
}

# --- fixed values: product events accepted by ingestion ----------------------
EVENT_NAMES = (
    "user_registered", "onboarding_completed", "brief_opened", "story_opened",
    "source_clicked", "category_followed", "entity_followed", "story_saved", "story_shared",
    "alert_created", "feedback_submitted", "report_generated", "whatsapp_interest_expressed",
)

# --- fixed values: confidence labels of a story ------------------------------
CONFIDENCE_LABELS = {
    "corrected": "Corregido después de publicación",
    "contradictory": "Existen versiones contradictorias",
    "official_statement": "Basado en comunicado oficial",
    "multi_source": "Confirmado por varias fuentes",
    "single_source": "Reportado por una sola fuente",
    "developing": "Información en desarrollo",
}

# --- fixed values: delivery --------------------------------------------------
CHANNELS = ("email", "telegram", "whatsapp")
PREFERRED_HOURS = {"manana": 9, "tarde": 16, "noche": 20}

# --- fixed values: weather places (key, name, department, country, lat, lon) --
WEATHER_LOCATIONS = (
    ("la_paz", "La Paz", "La Paz", "Bolivia", -16.5, -68.15),
    ("santa_cruz", "Santa Cruz", "Santa Cruz", "Bolivia", -17.78, -63.18),
    ("cochabamba", "Cochabamba", "Cochabamba", "Bolivia", -17.39, -66.16),
    ("oruro", "Oruro", "Oruro", "Bolivia", -17.96, -67.11),
    ("potosi", "Potosi", "Potosi", "Bolivia", -19.58, -65.75),
    ("tarija", "Tarija", "Tarija", "Bolivia", -21.53, -64.73),
    ("sucre", "Sucre", "Chuquisaca", "Bolivia", -19.03, -65.26),
    ("trinidad", "Trinidad", "Beni", "Bolivia", -14.83, -64.9),
    ("cobija", "Cobija", "Pando", "Bolivia", -11.03, -68.77),
)

# --- fixed values: scoring ---------------------------------------------------
SCORE_WEIGHTS = {
    "recency": "0.15",
    "source": "0.10",
    "content_quality": "0.17",
    "impact": "0.20",
    "local_relevance": "0.20",
    "corroboration": "0.10",
    "category_confidence": "0.08",
}
RECENCY_BUCKETS = ((1, 100), (3, 90), (6, 75), (12, 60), (24, 45), (48, 25))
SOURCE_SCORES = {
    "unitel": 82, "reduno": 84, "radiofides": 84, "redbolivision": 78, "opinion": 82,
    "el_deber": 84, "la_razon": 82,
}
SOURCE_ALIASES = {
    "red_uno": "reduno", "radio_fides": "radiofides", "red_bolivision": "redbolivision",
    "el_deber": "el_deber", "la_razon": "la_razon",
}
IMPACT_TERMS = (
    ("high", 100, (
        "bloqueo nacional", "estado de emergencia", "banco central", "crisis", "muertos",
        "fallecidos", "dolar", "elecciones", "combustible", "bloqueo indefinido",
        "escasez de combustible", "tipo de cambio", "riesgo pais", "conflicto social",
        "transporte pesado", "medidas de presion",
    )),
    ("medium", 70, (
        "bloqueo", "paro", "protesta", "inflacion", "deuda", "exportacion", "ley",
        "candidato", "gobierno", "seguridad",
    )),
    ("low", 35, ("anuncio", "reunion", "informe", "operativo", "campana")),
)
LOCAL_TERMS = (
    "bolivia", "boliviano", "boliviana", "gobierno boliviano", "autoridades bolivianas",
    "banco central", "banco central de bolivia", "santa cruz", "la paz", "cochabamba",
    "el alto", "oruro", "potosi", "tarija", "chuquisaca", "beni", "pando", "sucre",
    "chapare", "tropico", "ypfb", "aduana nacional", "senasag", "abc", "cob", "mas", "tse",
    "transporte", "bloqueos", "dialogo", "camara de diputados", "senado",
    "asamblea legislativa", "gobierno nacional", "presidente de bolivia", "vicepresidente",
    "ministerio de", "policia boliviana", "ejercito", "comite civico", "cruceño", "cruceña",
    "paceño", "paceña",
)
FOREIGN_TERMS = (
    "nepal", "colombia", "madrid", "sao paulo", "brasil", "argentina", "chile", "peru",
    "mexico", "estados unidos", "eeuu", "japon", "china", "europa", "venezuela", "ucrania",
    "rusia", "israel", "gaza", "francia", "espana", "portugal", "inglaterra", "croacia",
    "alemania", "italia", "argelia", "ecuador", "costa rica", "panama", "uruguay",
    "paraguay", "messi", "cristiano ronaldo", "neymar", "mundial", "copa del mundo",
    "copa america", "champions", "liga de campeones", "trump", "putin", "netanyahu",
    "zelenski", "iran", "corea", "papa francisco", "miami", "paris", "londres", "roma",
)
CONFIDENCE_BUCKETS = (("0.80", 100), ("0.60", 75), ("0.40", 55))


@dataclass(frozen=True)
class ScoringConfig:
    weights: dict = field(default_factory=lambda: dict(SCORE_WEIGHTS))
    recency_buckets: tuple = RECENCY_BUCKETS
    recency_default: int = 10
    recency_missing: int = 20
    source_scores: dict = field(default_factory=lambda: dict(SOURCE_SCORES))
    source_aliases: dict = field(default_factory=lambda: dict(SOURCE_ALIASES))
    source_default: int = 55
    quality_base: int = 35
    good_words: int = 120
    good_words_bonus: int = 20
    excellent_words: int = 300
    excellent_words_bonus: int = 10
    image_bonus: int = 10
    description_bonus: int = 10
    title_bonus: int = 10
    quality_max: int = 100
    impact_terms: tuple = IMPACT_TERMS
    local_terms: tuple = LOCAL_TERMS
    foreign_terms: tuple = FOREIGN_TERMS
    local_strong: int = 100
    local_medium: int = 75
    local_weak: int = 45
    foreign_only: int = 5
    two_sources: int = 70
    three_sources: int = 100
    confidence_buckets: tuple = CONFIDENCE_BUCKETS
    confidence_default: int = 35
    confidence_missing: int = 45
    missing_content: int = 25
    short_content: int = 15
    duplicated_description: int = 20
    missing_date: int = 10
    unknown_source: int = 8
    low_confidence: int = 10
    foreign_penalty: int = 20
    title_similarity: float = 0.82
    token_jaccard: float = 0.55
    text_chars: int | None = None  # whole texts; a number cuts them
    story_chars: int | None = None  # whole texts; a number cuts them


@dataclass(frozen=True)
class ClassifyConfig:
    title_weight: float = 3.0
    description_weight: float = 2.0
    content_weight: float = 1.0
    source_category_bonus: float = 2.5
    min_score: float = 2.0
    accept_margin: float = 2.0
    low_confidence: float = 0.62
    dominant_ratio: float = 0.5
    content_chars: int | None = None  # whole texts; a number cuts them
    ambiguous_risk: float = 10.0
    review_quota: int = 12
    opinion_min_confidence: float = 0.55


@dataclass(frozen=True)
class StoryConfig:
    lookback_days: int = 3
    threshold: float = 0.85
    title_weight: float = 0.65
    content_weight: float = 0.35
    short_title_threshold: float = 0.92
    content_reason_threshold: float = 0.96
    update_threshold: float = 0.92
    excerpt_chars: int = 280
    min_excerpt_words: int = 6
    title_dedup_threshold: float = 0.85


@dataclass(frozen=True)
class SummaryConfig:
    title_chars: int = 100
    summary_min_chars: int = 120
    summary_chars: int = 360
    fact_chars: int = 140
    claim_chars: int = 220
    claim_excerpt_chars: int = 160
    max_claims: int = 3
    per_category: int = 5
    extended_limit: int = 8
    extended_categories: tuple = ("politica", "economia")
    max_per_source: int = 2
    batch_rows: int = 10
    siblings: int = 4
    delivery_rows: int = 10
