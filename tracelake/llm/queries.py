"""The queries of the training-data operators. They have no SQL twin; tests/llm holds them against brute force."""

from tracelake.llm.abuse import p8_found, p8_rates, p8_scores
from tracelake.llm.encoding import p6_ids
from tracelake.llm.langid import p1_conversations, p1_found, p1_segments
from tracelake.llm.leakage import p5_found, p5_items
from tracelake.llm.mixing import p3_mix, p3_report
from tracelake.llm.packing import p7_pack, p7_report
from tracelake.llm.pairs import p4_all_defects, p4_found
from tracelake.llm.truncation import p2_found, p2_rates

_ALL = (
    p1_found, p1_segments, p1_conversations, p2_found, p2_rates, p3_mix, p3_report, p4_found, p4_all_defects,
    p5_found, p5_items, p6_ids, p7_pack, p7_report, p8_found, p8_scores, p8_rates,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {}
