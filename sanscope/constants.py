"""Fixed values that must equal the original tool's output text and rules.

FIXED VALUES (kept verbatim, in their natural order):
"""

# --- analysis CSV status words
ACTIVE = "Vigente"
EXPIRED = "Expirado"

# --- DNS record types accepted by the dig / dnslookup tools
ALLOWED_DNS_TYPES = ("A", "AAAA", "CNAME", "MX", "TXT", "NS", "SOA", "PTR")
# --- record-type order used when grouping a domain's DNS records
DNS_REPORT_TYPES = ("A", "AAAA", "CNAME", "MX", "NS", "TXT", "SOA")

# --- validation / result messages
MSG_TARGET_REQUIRED = "El target es requerido"
MSG_NO_URL = "Usa solo host/IP, no URL completa"
MSG_BAD_TARGET = "Target invalido"
MSG_BAD_DNS_TYPE = "Tipo DNS no permitido"
MSG_PARAM_TARGET_REQUIRED = "El parametro target es requerido"
MSG_PARAM_TARGET_QUERY_REQUIRED = "El parametro target/query es requerido"
MSG_NO_ANSWERS = "Sin registros de respuesta"
MSG_PING_NO_RTT = "100% packet loss o no responde a ping"
MSG_PING_FAILED = "100% packet loss"
MSG_CURL_PARSE = "Fallo al parsear curl output"
MSG_NOT_JSON = "Respuesta no JSON"
MSG_WHOIS_NONE = "No se encontraron resultados en nic.bo"
MSG_NO_COMMON_RECORDS = "No se encontraron registros comunes para este dominio."

# --- registry search page
WHOIS_HEADER_CELL = "Nombre de dominio"
WHOIS_DETAIL_MARKER = "revisar_contacto.php"
WHOIS_BASE_URL = "https://nic.bo/"
WHOIS_DEFAULT_CATEGORY = "General"
WHOIS_ZONES = (".ia.bo", ".bo")  # searched in this order; first hit per domain wins

# --- tool names written to the envelope ``action`` column
ACTIONS = ("crtsh", "dig", "dnslookup", "ping", "traceroute", "curl", "ipguide", "open_rank", "whois_bo")

# --- column prefixes of the tools' own fields
PREFIX_CRT = "crt_"
PREFIX_DIG = "dig_"
PREFIX_PING = "ping_"
PREFIX_CURL = "curl_"
PREFIX_IPG = "ipg_"
PREFIX_OPR = "opr_"
PREFIX_WHOIS = "whois_"

# --- defaults
DB_ROW_LIMIT = 30000  # value of the database search's row option; runs here have no limit unless one is given
DEFAULT_RANK_BATCH = 250

# --- envelope column order
ENVELOPE_COLUMNS = ("timestamp", "action", "target", "ok", "status", "error")
