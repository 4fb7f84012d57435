"""Fixed vocabulary.

Fixed values (must equal the W3C names the reference writes):
  rdf:type       http://www.w3.org/1999/02/22-rdf-syntax-ns#type
  xsd:integer    http://www.w3.org/2001/XMLSchema#integer
  xsd:decimal    http://www.w3.org/2001/XMLSchema#decimal
  xsd:dateTime   http://www.w3.org/2001/XMLSchema#dateTime
  xsd:boolean    http://www.w3.org/2001/XMLSchema#boolean
  adms:status    http://www.w3.org/ns/adms#status
  limits         100 triples per side of a changeset, 10 changesets per
                 file, 1000 files per feed request
"""

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_INTEGER = "http://www.w3.org/2001/XMLSchema#integer"
XSD_DECIMAL = "http://www.w3.org/2001/XMLSchema#decimal"
XSD_DATETIME = "http://www.w3.org/2001/XMLSchema#dateTime"
XSD_BOOLEAN = "http://www.w3.org/2001/XMLSchema#boolean"
ADMS_STATUS = "http://www.w3.org/ns/adms#status"

MAX_TRIPLES_PER_SIDE = 100
MAX_CHANGESETS_PER_FILE = 10
MAX_FILES_PER_REQUEST = 1000

# Our own naming for the test graph (FIXTURES §2).
TYPE_NS = "urn:t:"
PRED_NS = "urn:p:"
RES_NS = "urn:r:"
GRAPH_NS = "urn:g:"
PUBLICATION_GRAPH = "urn:g:publication"
EVENTS_GRAPH = "urn:g:events"
CONCEPT_SCHEME = "urn:r:region/3"

# Column order of a quad row and of a triple row (no graph).
TRIPLE_COLS = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]
QUAD_COLS = ["g"] + TRIPLE_COLS + ["o_key"]
# Lexical identity of a triple (what the N-Triples line encodes).
LEXICAL_KEY = TRIPLE_COLS
# Logical identity: canonical object text instead of the lexical form.
LOGICAL_KEY = ["s", "p", "o_key", "o_kind", "o_dt", "o_lang"]


def pred(column: str) -> str:
    return PRED_NS + column


def typ(name: str) -> str:
    return TYPE_NS + name
