"""Scalar and aggregate functions of the dialect as Spark SQL expressions.

A template names its arguments {0}, {1} and so on; {*} is all of them, {1*} all from the second on. A name maps to one
template, or to several by the number of arguments. Names that Spark has with the same meaning are in SAME, so that a
name that is in neither is known to be missing. Templates keep NULL in, NULL out unless the function says otherwise.
"""

from __future__ import annotations

import re

SAME = frozenset(
    """lower lcase upper ucase trim ltrim rtrim concat_ws substring substr replace left right reverse translate repeat
    initcap startswith endswith contains levenshtein soundex md5 sha1 sha2 crc32 bit_length octet_length
    array_contains array_position array_append array_remove array_distinct array_min array_max array_join flatten
    map_keys map_values map_entries map_from_entries map_from_arrays cardinality named_struct struct
    abs round power pow cbrt ln log10 log2 exp pi sin cos tan atan atan2 sinh cosh tanh degrees radians hypot rand random
    bit_count getbit shiftleft shiftright bin greatest least coalesce nullif ifnull nvl nvl2 decode zeroifnull nullifzero
    year month day dayofmonth hour minute second dayofyear quarter weekofyear last_day now current_timestamp current_date
    regexp_count regexp_substr split_part strpos json_array_length uuid version current_user user if
    count sum avg min max stddev stddev_samp stddev_pop variance var_samp var_pop bool_and bool_or every any some bit_and
    bit_or bit_xor median percentile mode covar_pop covar_samp corr max_by min_by count_if approx_count_distinct
    regr_slope regr_intercept regr_count regr_r2 regr_avgx regr_avgy regr_sxx regr_syy regr_sxy any_value first last
    percentile_cont percentile_disc listagg collect_list collect_set array_agg grouping grouping_id
    row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value
    explode posexplode sequence transform filter aggregate exists forall zip_with array array_sort sort_array size
    cast try_cast extract interval date timestamp trunc element_at try_element_at overlay position char_length length
    date_format from_json to_timestamp unix_micros make_interval typeof try_to_date format_string monotonically_increasing_id
    struct_pack array_union array_intersect array_except slice map map_contains_key inline stack in values over
    unix_millis timestamp_micros timestamp_seconds isnull isnotnull""".split()
)

_NUM = "(a, x) -> a + x"
#: Arguments that need no brackets.
SIMPLE = re.compile(r"[\w.`]+|'(?:[^'\\]|\\.)*'|\w+\([^()]*\)|\([^()]*\)")

TEMPLATES: dict[str, str | dict[int, str]] = {
    # strings
    "concat": "concat_ws('', {*})",
    "ascii": "ascii(nullif({0}, ''))",
    "ord": "ascii(nullif({0}, ''))",
    "unicode": "ascii(nullif({0}, ''))",
    "chr": "decode(unhex(lpad(hex({0}), 8, '0')), 'UTF-32')",
    "char": "decode(unhex(lpad(hex({0}), 8, '0')), 'UTF-32')",
    "strip_accents": "translate({0}, 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ', 'aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY')",
    "bar": {4: "repeat('█', cast(round(least(greatest(({0} - {1}) / ({2} - {1}), 0), 1) * {3}) as int))", 3: "repeat('█', cast(round(least(greatest(({0} - {1}) / ({2} - {1}), 0), 1) * 80) as int))"},
    "lpad": {2: "lpad({0}, {1}, ' ')", 3: "lpad({0}, {1}, {2})"},
    "rpad": {2: "rpad({0}, {1}, ' ')", 3: "rpad({0}, {1}, {2})"},
    "instr": "cast(instr({0}, {1}) as bigint)",
    "strpos": "cast(instr({0}, {1}) as bigint)",
    "length": "cast(length({0}) as bigint)",
    "char_length": "cast(length({0}) as bigint)",
    "character_length": "cast(length({0}) as bigint)",
    "string_split": "split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)",
    "str_split": "split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)",
    "string_to_array": "split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)",
    "split": {1: "split({0}, ',', -1)", 2: "split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)"},
    "starts_with": "startswith({0}, {1})",
    "prefix": "startswith({0}, {1})",
    "ends_with": "endswith({0}, {1})",
    "suffix": "endswith({0}, {1})",
    "format": "format_string(replace({0}, '{{}}', '%s'), {1*})",
    "printf": "format_string({*})",
    "sprintf": "format_string({*})",
    # regular expressions
    "regexp_matches": "{0} rlike {1}",
    "regexp_like": "{0} rlike {1}",
    "regexp": "{0} rlike {1}",
    "regexp_replace": {3: "if(regexp_instr({0}, {1}) = 0, {0}, concat(left({0}, regexp_instr({0}, {1}) - 1), regexp_replace(regexp_extract({0}, {1}, 0), {1}, {2}), substring({0}, regexp_instr({0}, {1}) + length(regexp_extract({0}, {1}, 0)))))", 4: "regexp_replace({0}, {1}, {2})"},
    "regexp_extract": {2: "regexp_extract({0}, {1}, 0)", 3: "regexp_extract({0}, {1}, {2})"},
    "regexp_split_to_array": "split({0}, {1}, -1)",
    "regexp_extract_all": {2: "regexp_extract_all({0}, {1}, 0)", 3: "regexp_extract_all({0}, {1}, {2})"},
    # lists
    "list_value": "array({*})",
    "list_extract": "try_element_at({0}, {1})",
    "array_extract": "try_element_at({0}, {1})",
    "list_element": "try_element_at({0}, {1})",
    "list_length": "cast(size({0}) as bigint)",
    "array_length": "cast(size({0}) as bigint)",
    "len": "cast(size({0}) as bigint)",
    "list_concat": "concat({*})",
    "array_concat": "concat({*})",
    "list_contains": "array_contains({0}, {1})",
    "array_has": "array_contains({0}, {1})",
    "list_has": "array_contains({0}, {1})",
    "list_slice": "slice({0}, {1}, greatest({2} - {1} + 1, 0))",
    "array_slice": "slice({0}, {1}, greatest({2} - {1} + 1, 0))",
    "list_position": "cast(nullif(array_position({0}, {1}), 0) as int)",
    "array_indexof": "cast(nullif(array_position({0}, {1}), 0) as int)",
    "list_indexof": "cast(nullif(array_position({0}, {1}), 0) as int)",
    "list_append": "array_append({0}, {1})",
    "array_push_back": "array_append({0}, {1})",
    "list_prepend": "array_prepend({1}, {0})",
    "array_prepend": "array_prepend({1}, {0})",
    "array_push_front": "array_prepend({0}, {1})",
    "list_reverse": "reverse({0})",
    "array_reverse": "reverse({0})",
    "list_remove": "array_remove({0}, {1})",
    "list_distinct": "array_distinct({0})",
    "list_unique": "array_distinct({0})",
    "list_sort": "array_sort({0})",
    "list_sum": f"aggregate(filter({{0}}, x -> x is not null), 0D, {_NUM})",
    "array_sum": f"aggregate(filter({{0}}, x -> x is not null), 0D, {_NUM})",
    "list_avg": f"try_divide(aggregate(filter({{0}}, x -> x is not null), 0D, {_NUM}), size(filter({{0}}, x -> x is not null)))",
    "array_avg": f"try_divide(aggregate(filter({{0}}, x -> x is not null), 0D, {_NUM}), size(filter({{0}}, x -> x is not null)))",
    "list_min": "array_min({0})",
    "list_max": "array_max({0})",
    "list_product": "aggregate(filter({0}, x -> x is not null), 1D, (a, x) -> a * x)",
    "array_product": "aggregate(filter({0}, x -> x is not null), 1D, (a, x) -> a * x)",
    "list_any": "exists({0}, x -> coalesce(x, false))",
    "array_any": "exists({0}, x -> coalesce(x, false))",
    "list_bool_or": "exists({0}, x -> coalesce(x, false))",
    "list_all": "forall({0}, x -> coalesce(x, false))",
    "array_all": "forall({0}, x -> coalesce(x, false))",
    "list_bool_and": "forall({0}, x -> coalesce(x, false))",
    "list_count": "cast(size(array_compact({0})) as bigint)",
    "array_count": "cast(size(array_compact({0})) as bigint)",
    "list_string_agg": {1: "array_join({0}, ',')", 2: "array_join({0}, {1})"},
    "array_string_agg": {1: "array_join({0}, ',')", 2: "array_join({0}, {1})"},
    "array_to_string": {1: "array_join({0}, ',')", 2: "array_join({0}, {1})"},
    "list_to_string": {1: "array_join({0}, ',')", 2: "array_join({0}, {1})"},
    "list_filter": {1: "array_compact({0})", 2: "filter({0}, {1})"},
    "list_transform": "transform({0}, {1})",
    "generate_series": {1: "sequence(0, {0})", 2: "sequence({0}, {1})", 3: "sequence({0}, {1}, {2})"},
    "range": {1: "slice(sequence(0, {0}), 1, {0})", 2: "filter(sequence({0}, {1}), x -> x < {1})", 3: "filter(sequence({0}, {1}, {2}), x -> x <> {1})"},
    "unnest": "explode({0})",
    # maps and structs
    "map": "map_from_arrays({0}, {1})",
    "map_contains": "map_contains_key({0}, {1})",
    "map_has": "map_contains_key({0}, {1})",
    "map_extract": "try_element_at({0}, {1})",
    "element_at": "try_element_at({0}, {1})",
    "row": "struct({*})",
    "struct_pack": "named_struct({*})",
    "struct_extract": "{0}[{1}]",
    "struct_keys": "json_object_keys(to_json({0}, map('ignoreNullFields', 'false')))",
    "struct_values": "map_values(from_json(to_json({0}, map('ignoreNullFields', 'false')), 'map<string,string>'))",
    # numbers
    "ceil": "cast(ceil({0}) as double)",
    "ceiling": "cast(ceil({0}) as double)",
    "floor": "cast(floor({0}) as double)",
    "trunc": {1: "if({0} >= 0, cast(floor({0}) as double), cast(ceil({0}) as double))", 2: "if({0} >= 0, floor({0} * pow(10, {1})), ceil({0} * pow(10, {1}))) / pow(10, {1})"},
    "truncate": {1: "if({0} >= 0, cast(floor({0}) as double), cast(ceil({0}) as double))", 2: "if({0} >= 0, floor({0} * pow(10, {1})), ceil({0} * pow(10, {1}))) / pow(10, {1})"},
    "sqrt": "if({0} >= 0, sqrt({0}), null)",
    "log": "log10({0})",
    "sign": "cast(signum({0}) as int)",
    "mod": "try_mod({0}, {1})",
    "asin": "if(abs({0}) <= 1, asin({0}), null)",
    "acos": "if(abs({0}) <= 1, acos({0}), null)",
    "factorial": "factorial({0})",
    "gcd": "millrace_gcd({0}, {1})",
    "lcm": "millrace_lcm({0}, {1})",
    "even": "cast(if({0} >= 0, ceil({0} / 2), floor({0} / 2)) * 2 as double)",
    "odd": "cast(if({0} >= 0, ceil(({0} - 1) / 2) * 2 + 1, floor(({0} + 1) / 2) * 2 - 1) as double)",
    "div": "({0}) div nullif({1}, 0)",
    "isnan": "if({0} is null, null, isnan({0}))",
    "isinf": "abs({0}) = double('infinity')",
    "isfinite": "not isnan({0}) and abs({0}) < double('infinity')",
    "gamma": "exp(millrace_lgamma({0}))",
    "lgamma": "millrace_lgamma({0})",
    "nextafter": "millrace_nextafter({0}, {1})",
    "fmod": "try_mod({0}, {1})",
    "copysign": "abs({0}) * if({1} < 0 or cast({1} as string) = '-0.0', -1, 1)",
    "ldexp": "{0} * pow(2, {1})",
    "signbit": "({0} < 0 or cast({0} as string) = '-0.0')",
    "fdim": "greatest({0} - {1}, 0D)",
    "fma": "({0} * {1} + {2})",
    "remainder": "({0} - round({0} / {1}) * {1})",
    "ieee_remainder": "({0} - round({0} / {1}) * {1})",
    "random": "rand()",
    # bits, hashes
    "gen_random_uuid": "uuid()",
    "hash": "xxhash64({*})",
    "byte_length": "cast(octet_length({0}) as bigint)",
    "octet_length": "cast(octet_length({0}) as bigint)",
    "bit_length": "cast(bit_length({0}) as bigint)",
    "bitand": "({0} & {1})",
    "bitor": "({0} | {1})",
    "bitxor": "({0} ^ {1})",
    "xor": "({0} ^ {1})",
    "bit_not": "(~{0})",
    "bitnot": "(~{0})",
    "left_shift": "shiftleft({0}, {1})",
    "lshift": "shiftleft({0}, {1})",
    "right_shift": "shiftright({0}, {1})",
    "rshift": "shiftright({0}, {1})",
    "get_bit": "cast(if({1} >= 64, 0, getbit(cast({0} as bigint), least({1}, 63))) as int)",
    "set_bit": {2: "(cast({0} as bigint) | shiftleft(1L, {1}))", 3: "if({2} = 1, cast({0} as bigint) | shiftleft(1L, {1}), cast({0} as bigint) & ~shiftleft(1L, {1}))"},
    "bitstring": {1: "lpad(bin(abs({0})), 64, '0')", 2: "lpad(bin(abs({0})), {1}, '0')"},
    "to_bin": "bin({0})",
    # formats
    "lpad_zero": "lpad({0}, greatest({1}, length({0})), '0')",
    "zfill": "lpad({0}, greatest({1}, length({0})), '0')",
    "hex": "lower(hex({0}))",
    "to_hex": "lower(hex({0}))",
    "oct": "conv({0}, 10, 8)",
    "to_oct": "conv({0}, 10, 8)",
    "unhex": "decode(unhex({0}), 'UTF-8')",
    "from_hex": "decode(unhex({0}), 'UTF-8')",
    "base64": "base64(cast({0} as binary))",
    "to_base64": "base64(cast({0} as binary))",
    "from_base64": "decode(unbase64({0}), 'UTF-8')",
    "decode_base64": "decode(unbase64({0}), 'UTF-8')",
    # MiB is the last unit, as in the SQL of fn_formats; pg_size_pretty, which no SQL fixes, goes on.
    "format_bytes": "case when {0} < 1024 then concat({0}, ' B') when {0} < 1048576 then concat({0} div 1024, ' KiB') else concat({0} div 1048576, ' MiB') end",
    "pg_size_pretty": "case when {0} < 1024 then concat({0}, ' B') when {0} < 1048576 then concat({0} div 1024, ' KiB') when {0} < 1073741824 then concat({0} div 1048576, ' MiB') else concat({0} div 1073741824, ' GiB') end",
    # similarity
    **{f: "cast(levenshtein({0}, {1}) as bigint)" for f in ("levenshtein", "editdist", "edit_distance")},
    "hamming": "if(octet_length({0}) <> octet_length({1}), null, cast(aggregate(zip_with(split({0}, ''), split({1}, ''), (a, b) -> if(a <> b, 1, 0)), 0, (s, x) -> s + x) as bigint))",
    "hamming_distance": "if(octet_length({0}) <> octet_length({1}), null, cast(aggregate(zip_with(split({0}, ''), split({1}, ''), (a, b) -> if(a <> b, 1, 0)), 0, (s, x) -> s + x) as bigint))",
    "jaccard": "if({0} = '' and {1} = '', 1D, size(array_intersect(split({0}, ''), split({1}, ''))) / size(array_union(split({0}, ''), split({1}, ''))))",
    "jaccard_similarity": "if({0} = '' and {1} = '', 1D, size(array_intersect(split({0}, ''), split({1}, ''))) / size(array_union(split({0}, ''), split({1}, ''))))",
    "jaro": "millrace_jaro({0}, {1})",
    "jaro_similarity": "millrace_jaro({0}, {1})",
    "jaro_winkler": "millrace_jaro({0}, {1})",
    # conditions
    "iif": "if({0}, {1}, {2})",
    "choose": "elt({0}, {1*})",
    "ifnot": "if(not coalesce({0}, false), {1}, null)",
    # system
    "current_database": "'memory'",
    "database": "'memory'",
    "current_catalog": "'memory'",
    "current_schema": "'main'",
    "schema": "'main'",
    "session_user": "current_user()",
    "current_setting": "case lower({0}) when 'timezone' then current_timezone() end",
    "alias": "{0}",
    "error": "raise_error({0})",
    "constant_or_null": "{0}",
    "stats": "'no statistics'",
    "typeof": "case typeof({0}) when 'int' then 'INTEGER' when 'string' then 'VARCHAR' when 'timestamp_ntz' then 'TIMESTAMP' when 'timestamp' then 'TIMESTAMP WITH TIME ZONE' else upper(typeof({0})) end",
    "pg_typeof": "case typeof({0}) when 'int' then 'integer' when 'string' then 'text' when 'double' then 'double precision' when 'float' then 'real' when 'timestamp_ntz' then 'timestamp without time zone' when 'timestamp' then 'timestamp with time zone' else typeof({0}) end",
    # dates and times
    **{f: f"cast({f}({{0}}) as bigint)" for f in ("year", "month", "day", "dayofmonth", "hour", "minute", "second", "quarter", "weekofyear", "dayofyear")},
    "date_part": "cast(floor(date_part({0}, {1})) as bigint)",
    "dayofweek": "cast(dayofweek({0}) - 1 as bigint)",
    "dow": "cast(dayofweek({0}) - 1 as bigint)",
    "doy": "cast(dayofyear({0}) as bigint)",
    "week": "cast(weekofyear({0}) as bigint)",
    "dayname": "date_format({0}, 'EEEE')",
    "monthname": "date_format({0}, 'MMMM')",
    "date_trunc": "date_trunc({0}, {1})",
    "date_add": {2: "dateadd({0}, {1})", 3: "case lower({2}) when 'month' then add_months({0}, {1}) when 'year' then add_months({0}, 12 * {1}) when 'week' then dateadd({0}, 7 * {1}) else dateadd({0}, {1}) end"},
    "dateadd": {2: "dateadd({0}, {1})", 3: "case lower({2}) when 'month' then add_months({0}, {1}) when 'year' then add_months({0}, 12 * {1}) when 'week' then dateadd({0}, 7 * {1}) else dateadd({0}, {1}) end"},
    "date_sub": {2: "date_sub({0}, {1})", 3: "case lower({2}) when 'month' then add_months({0}, -{1}) when 'year' then add_months({0}, -12 * {1}) when 'week' then date_sub({0}, 7 * {1}) else date_sub({0}, {1}) end"},
    "datesub": {2: "date_sub({0}, {1})", 3: "case lower({2}) when 'month' then add_months({0}, -{1}) when 'year' then add_months({0}, -12 * {1}) when 'week' then date_sub({0}, 7 * {1}) else date_sub({0}, {1}) end"},
    "datediff": {2: "cast(datediff({1}, {0}) as bigint)", 3: "cast(datediff({2}, {1}) as bigint)"},
    "date_diff": {2: "cast(datediff({1}, {0}) as bigint)", 3: "cast(datediff({2}, {1}) as bigint)"},
    "make_date": "try_to_date(format_string('%04d-%02d-%02d', cast({0} as int), cast({1} as int), cast({2} as int)))",
    "make_timestamp": "try_make_timestamp_ntz({0}, {1}, {2}, {3}, {4}, {5})",
    "epoch": "unix_micros(cast({0} as timestamp)) / 1e6",
    "epoch_ms": "unix_millis(cast({0} as timestamp))",
    "epoch_us": "unix_micros(cast({0} as timestamp))",
    "epoch_ns": "unix_micros(cast({0} as timestamp)) * 1000",
    "to_date": "try_to_date({0})",
    "strptime": "to_timestamp_ntz({0}, {1})",
    "age": "format_string('%d years %d months %d days', cast(months_between({0}, {1}) as int) div 12, cast(months_between({0}, {1}) as int) % 12, datediff({0}, add_months({1}, cast(months_between({0}, {1}) as int))))",
    # JSON
    "json_extract": "get_json_object({0}, if(startswith({1}, '$'), {1}, concat('$.', {1})))",
    "json_extract_path": "get_json_object({0}, concat('$.', {1}))",
    "json_value": "get_json_object({0}, if(startswith({1}, '$'), {1}, concat('$.', {1})))",
    "json_extract_string": "get_json_object({0}, if(startswith({1}, '$'), {1}, concat('$.', {1})))",
    "try_json_extract": "get_json_object({0}, concat('$.', regexp_replace({1}, '[.]([0-9]+)', '[$1]')))",
    "json_extract_path_text": "get_json_object({0}, concat('$.', regexp_replace({1}, '[.]([0-9]+)', '[$1]')))",
    "json_type": "case when {0} is null then null when schema_of_variant(try_parse_json({0})) like 'OBJECT%' then 'OBJECT' when schema_of_variant(try_parse_json({0})) like 'ARRAY%' then 'ARRAY' else schema_of_variant(try_parse_json({0})) end",
    "json_valid": "if({0} is null, null, try_parse_json({0}) is not null)",
    "json_keys": "array_sort(json_object_keys({0}))",
    "json": "to_json({0})",
    "to_json": "to_json({0})",
    "json_serialize": "to_json({0})",
    "json_array": "to_json(array({*}))",
    "json_object": "to_json(named_struct({*}), map('ignoreNullFields', 'false'))",
    "json_merge_patch": "millrace_merge_patch({0}, {1})",
    "json_contains": "contains(lower({0}), lower({1}))",
    "json_quote": "substring(to_json(array({0})), 2, length(to_json(array({0}))) - 2)",
    "json_deserialize": "try_parse_json({0})",
    "json_parse": "try_parse_json({0})",
    # aggregates
    "list": "transform(collect_list(struct({0} as v)), s -> s.v)",
    "list_agg": "transform(collect_list(struct({0} as v)), s -> s.v)",
    "array_agg": "transform(collect_list(struct({0} as v)), s -> s.v)",
    "string_agg": {1: "listagg({0}, ',')", 2: "listagg({0}, {1})"},
    "group_concat": {1: "listagg({0}, ',')", 2: "listagg({0}, {1})"},
    # Signs and zeros are counted apart from the sum of logarithms.
    "product": "case when count({0}) = 0 then null when count_if({0} = 0) > 0 then 0D else exp(sum(ln(abs(nullif({0}, 0))))) * if(count_if({0} < 0) % 2 = 1, -1, 1) end",
    "quantile": {1: "percentile_disc(0.5) within group (order by {0})", 2: "percentile_disc({1}) within group (order by {0})"},
    "quantile_cont": "percentile({0}, {1})",
    "quantile_disc": "percentile_disc({1}) within group (order by {0})",
    "approx_quantile": "percentile_approx({0}, {1}, 10000)",
    "arg_max": "max_by({0}, {1})",
    "argmax": "max_by({0}, {1})",
    "arg_min": "min_by({0}, {1})",
    "argmin": "min_by({0}, {1})",
    "kurtosis_pop": "kurtosis({0})",
    "kurtosis": "((count({0}) - 1D) / ((count({0}) - 2D) * (count({0}) - 3D)) * ((count({0}) + 1D) * kurtosis({0}) + 6))",
    "skewness": "(skewness({0}) * sqrt(count({0}) * (count({0}) - 1D)) / (count({0}) - 2D))",
    "skew": "(skewness({0}) * sqrt(count({0}) * (count({0}) - 1D)) / (count({0}) - 2D))",
    "approx_distinct": "approx_count_distinct({0})",
    "arbitrary": "any_value({0}, true)",
    "any_value": "any_value({0}, true)",
    "fsum": "sum(cast({0} as double))",
    "kahan_sum": "sum(cast({0} as double))",
    "countif": "count_if({0})",
    "sum_if": "sum(case when {1} then {0} end)",
    "sumif": "sum(case when {1} then {0} end)",
    "avg_if": "avg(case when {1} then {0} end)",
    "avgif": "avg(case when {1} then {0} end)",
    "min_if": "min(case when {1} then {0} end)",
    "minif": "min(case when {1} then {0} end)",
    "max_if": "max(case when {1} then {0} end)",
    "maxif": "max(case when {1} then {0} end)",
    "bool_and": "bool_and({0})",
    "json_group_array": "to_json(collect_list({0}))",
    "json_agg": "to_json(collect_list({0}))",
    "json_group_object": "to_json(map_from_entries(collect_list(struct({0}, {1}))))",
}

def render(name: str, args: list[str]) -> str | None:
    """The Spark expression for a call, or None if the name isn't one that differs."""
    template = TEMPLATES.get(name.lower())
    if isinstance(template, dict):
        template = template.get(len(args))
    if template is None:
        return None
    args = [a if SIMPLE.fullmatch(a) or "->" in a else f"({a})" for a in args]
    out, i = [], 0
    while i < len(template):
        if template.startswith("{{", i) or template.startswith("}}", i):
            out.append(template[i])
            i += 2
        elif template[i] == "{":
            stop = template.index("}", i)
            part = template[i + 1 : stop]
            if part.endswith("*"):
                out.append(", ".join(args[int(part[:-1] or 0) :]))
            else:
                out.append(args[int(part)] if int(part) < len(args) else "null")
            i = stop + 1
        else:
            out.append(template[i])
            i += 1
    return "".join(out)
