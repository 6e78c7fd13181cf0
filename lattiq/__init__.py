"""Dense time series and array states on Spark: index, predict, quantize, reconstruct, audit."""

from .functions.numeric import dequantized, inverse_transformed, linear, quantized, scheme_tag, tau_of, transformed, unzigzag, wrapped, zigzag
from .operators.arrays import cells, compact_payload, payload_audit, remap_exceptions, roi_prefix, split_channels, tile_scales
from .operators.audit import cadence_stats, cadence_violations, digests, finite, mismatches, monotonic, size_outliers
from .operators.codec import decoded, encoded, endpoint_join, error_sums, metrics, predicted
from .operators.difference import adaptive_order, chunked, delta, keyframe_chain, keyframe_orders, restored
from .operators.index import bracket, covering_range, gop_ranges, out_of_range, prefetch, with_positions
from .operators.lifecycle import allocation, combined_history, latest, newest, preferred, rollback
from .operators.requests import attribute_between, coverage, distinct_requests, evicted, first_errors, first_middles, reused_digests, selected_scheme, service_counters
from .operators.schemes import LEGACY_U8, LOCAL_U8, Scheme, decode_schemes, encode_schemes, field_residuals
from .plans.rollback import rollback as rollback_run
from .plans.sequence import Profile, decode, encode, verify
from .plans.states import comparison, comparison_report, decode_states, encode_states
from .session import session, table
from .sources.members import packed, read_frames, repacked, transcoded, unpacked, write_members
from .sources.runs import finalize, integrity_errors, read_checkpoints, read_history, wait_finished

__all__ = [n for n in dir() if not n.startswith("_") and n not in {"functions", "operators", "plans", "sources", "streaming"}]
