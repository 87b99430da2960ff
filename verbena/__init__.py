"""A tidy, pipe-based grammar of data manipulation, compiled to Spark plans."""

from verbena.expr import Fx, Symbolic, _, explain, sql_raw
from verbena.functions.dates import ceil_date, floor_date
from verbena.functions.factors import fct_collapse, fct_infreq, fct_inorder, fct_lump, fct_recode, fct_reorder, fct_rev, levels
from verbena.functions.registry import column_function
from verbena.functions.strings import str_c
from verbena.functions.vector import between, case_when, coalesce, cumall, cumany, cume_dist, cummean, dense_rank, desc, first, if_else, lag, last, lead, min_rank, n, n_distinct, na_if, near, nth, ntile, percent_rank, row_number
from verbena.operators.across import across
from verbena.operators.basic import arrange, distinct, drop_missing, filter, head, mutate, rename, repeat_rows, sample_rows, select, summary, tail, top_n, transmute
from verbena.operators.grouping import add_count, count, cube, group_apply, group_by, rollup, summarise, summarize, ungroup
from verbena.operators.joins import anti_join, bind_rows, full_join, inner_join, intersect, join, left_join, outer_join, right_join, semi_join, setdiff, union, union_all
from verbena.operators.reshape import build_longer_spec, build_wider_spec, complete, expand, extract, gather, nest, pivot_longer, pivot_longer_spec, pivot_wider, pivot_wider_spec, separate, spread, unite, unnest, vec_as_names
from verbena.sources.read import collect, load_dataset, read_table, show_query, write_table
from verbena.streaming.windows import session_window, time_window, watermark
from verbena.table import Pipe, Tbl, call, pipe, tbl, verb
from verbena.tidyselect import where
from verbena.translate import TranslationError

#: Grouped verbs need no fast variants here; the names are kept for users who have them in their code.
fast_mutate, fast_filter, fast_summarize = mutate, filter, summarize

__all__ = [name for name in dir() if not name.startswith("__")] + ["_"]
