"""The queries of this subpackage, and SQL for those that SQL can express."""

from .hilbert import op8_hilbert
from .langid import op3_langid
from .lattice import op6_lattice
from .line_crf import op1_line_crf
from .mixing import OP5_SQL, op5_mixing
from .simhash import op2_simhash
from .spaced_seeds import op9_spaced_seeds
from .suffix_merge import op10_suffix_merge
from .token_order import op7_token_order
from .warc import OP4_SQL, op4_warc

QUERIES = {f.__name__: f for f in (op1_line_crf, op2_simhash, op3_langid, op4_warc, op5_mixing, op6_lattice, op7_token_order, op8_hilbert, op9_spaced_seeds, op10_suffix_merge)}
ORACLES = {"op4_warc": OP4_SQL, "op5_mixing": OP5_SQL}
