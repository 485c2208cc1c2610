"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from millrace.llm.ann import OP1_SQL, op1_nearest
from millrace.llm.chat import OP2_SQL, op2_chat_formatting
from millrace.llm.lm import op6_lm_scoring
from millrace.llm.packing import op10_packing
from millrace.llm.pieces import op8_pieces
from millrace.llm.quality_classifier import op5_quality_classifier
from millrace.llm.quality_rules import op4_quality_rules
from millrace.llm.simhash import op7_simhash
from millrace.llm.toxicity import op9_toxicity
from millrace.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_warc": op3_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_simhash": op7_simhash,
    "op8_pieces": op8_pieces,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
}

ORACLE_SQL = {"op1_nearest": OP1_SQL, "op2_chat_formatting": OP2_SQL, "op3_warc": OP3_SQL}
