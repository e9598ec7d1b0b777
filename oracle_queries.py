"""The registered queries once more, as plain SQL over the test tables.

Written from the definition of each result and independent of the library: objects
are compared by their full ordered content, nodes are aligned by a full outer join
and lines are numbered by a window.
"""

from __future__ import annotations

import re

_SCHEMA_CASE = (
    "case when {k} % 50 = 7 then 'pg_catalog' when {k} % 50 = 8 then 'information_schema' "
    "else concat('s', cast({k} % 5 as string)) end"
)
_ORDER_SCHEMA = _SCHEMA_CASE.format(k="o_custkey")
_PART_SCHEMA = _SCHEMA_CASE.format(k="p_partkey")
_VIEW_SCHEMA = _SCHEMA_CASE.format(k="c_custkey")

# Each relation: (name, SQL). Later ones may use earlier ones.
_RELATIONS: list[tuple[str, str]] = [
    (
        "schema_scope",
        """select r_regionkey snapshot_id,
          case when r_regionkey > 0 then concat('s', cast(r_regionkey as string)) end
            schema_name from region""",
    ),
    (
        "snapshots",
        "select r_regionkey snapshot_id, r_name name, null::varchar schema_name from region",
    ),
    ("pairs", "select 0 source_id, r_regionkey target_id from region where r_regionkey > 0"),
    (
        "cat_columns",
        f"""select r_regionkey snapshot_id, {_ORDER_SCHEMA} table_schema,
          concat('customer_', cast(o_custkey as string)) table_name,
          concat('o_', cast(o_orderkey as string)) column_name,
          case when r_regionkey > 0 and (o_orderkey + r_regionkey) % 97 = 0 then 'text'
            else o_orderpriority end data_type,
          case when o_orderstatus = 'O' then 'YES' else 'NO' end is_nullable,
          case when o_orderkey % 3 = 0 then null else o_orderstatus end column_default,
          cast(row_number() over (partition by r_regionkey, o_custkey order by o_orderkey)
            as int) ordinal_position
        from orders cross join region where (o_custkey + r_regionkey) % 11 <> 0""",
    ),
    (
        "cat_indexes",
        f"""select r_regionkey snapshot_id, {_ORDER_SCHEMA} schemaname,
          concat('customer_', cast(o_custkey as string)) tablename,
          concat('ix_', cast(o_orderkey as string)) indexname,
          concat(case when o_orderkey % 2 = 0 then 'CREATE UNIQUE INDEX '
            else 'CREATE INDEX ' end, 'ix_', cast(o_orderkey as string)) indexdef
        from orders cross join region
        where o_orderkey % 7 = 0 and (o_custkey + r_regionkey) % 11 <> 0
        union all
        select r_regionkey, {_PART_SCHEMA}, concat('part_', cast(p_partkey as string)),
          concat('pix_', cast(p_partkey as string)), 'CREATE INDEX pix'
        from part cross join region
        where p_partkey % 10 = 0 and (p_partkey + r_regionkey) % 13 <> 0""",
    ),
    (
        "cat_table_constraints",
        f"""select r_regionkey snapshot_id, {_ORDER_SCHEMA} table_schema,
          concat('customer_', cast(o_custkey as string)) table_name,
          concat('k_', cast(o_orderkey as string)) constraint_name,
          case o_orderkey % 5 when 0 then 'PRIMARY KEY' when 1 then 'FOREIGN KEY'
            when 2 then 'UNIQUE' when 3 then 'CHECK' else 'EXCLUDE' end constraint_type
        from orders cross join region
        where o_orderkey % 6 = 0 and (o_custkey + r_regionkey) % 11 <> 0""",
    ),
    (
        "cat_key_column_usage",
        f"""select r_regionkey snapshot_id, {_ORDER_SCHEMA} table_schema,
          concat('customer_', cast(o_custkey as string)) table_name,
          concat('k_', cast(o_orderkey as string)) constraint_name,
          concat('c', cast(l_partkey as string)) column_name,
          l_linenumber ordinal_position
        from lineitem join orders on l_orderkey = o_orderkey cross join region
        where o_orderkey % 6 = 0 and o_orderkey % 5 < 3""",
    ),
    (
        "cat_views",
        f"""select r_regionkey snapshot_id, {_VIEW_SCHEMA} table_schema,
          concat('customer_', cast(c_custkey as string)) table_name
        from customer cross join region
        where c_custkey % 20 = 3 and (c_custkey + r_regionkey) % 11 <> 0
        union all
        select r_regionkey, 's0', concat('supplier_', cast(s_suppkey as string))
        from supplier cross join region where s_suppkey % 10 = 0""",
    ),
    (
        "cat_proc",
        """select r_regionkey snapshot_id, p_partkey oid,
          concat('fn_', cast(p_partkey % 400 as string)) proname,
          p_partkey % 25 pronamespace, p_partkey % 5 prolang,
          case p_size % 4 when 2 then 'p' when 3 then 'a' else 'f' end prokind,
          case when r_regionkey > 0 and (p_partkey + r_regionkey) % 31 = 0 then 'void'
            else p_type end return_type,
          concat(p_brand, ' ', p_name) arguments
        from part cross join region where (p_partkey + r_regionkey) % 17 <> 0""",
    ),
    (
        "cat_namespace",
        """select r_regionkey snapshot_id, n_nationkey oid,
          case when n_nationkey = 0 then 'pg_catalog' else n_name end nspname
        from nation cross join region""",
    ),
    (
        "cat_language",
        """select s.r_regionkey snapshot_id, l.r_regionkey oid, l.r_name lanname
        from region s cross join region l""",
    ),
    (
        "cat_sequences",
        """select r_regionkey snapshot_id,
          concat('s', cast(s_suppkey % 5 as string)) sequence_schema,
          concat('seq_', cast(s_suppkey as string)) sequence_name,
          'bigint' data_type, cast(s_suppkey as string) start_value,
          case when r_regionkey > 0 and (s_suppkey + r_regionkey) % 9 = 0 then '10'
            else '1' end increment
        from supplier cross join region where (s_suppkey + r_regionkey) % 11 <> 0""",
    ),
    # Mapped entries.
    (
        "m_columns",
        """select snapshot_id, table_schema schema_name, table_name, column_name, data_type,
          is_nullable = 'YES' is_nullable, column_default default_value, ordinal_position
        from cat_columns where table_schema not in ('pg_catalog', 'information_schema')""",
    ),
    (
        "m_indexes",
        """select snapshot_id, schemaname schema_name, tablename table_name,
          indexname index_name, indexdef definition,
          contains(upper(indexdef), 'UNIQUE') is_unique
        from cat_indexes where schemaname not in ('pg_catalog', 'information_schema')""",
    ),
    (
        "constraint_keys",
        """select c.snapshot_id, c.table_schema schema_name, c.table_name, c.constraint_name,
          c.constraint_type,
          coalesce(string_agg(k.column_name, ',' order by k.ordinal_position, k.column_name),
            '') key_columns
        from cat_table_constraints c left join cat_key_column_usage k
          on c.snapshot_id = k.snapshot_id and c.table_schema = k.table_schema
          and c.table_name = k.table_name and c.constraint_name = k.constraint_name
        where c.table_schema not in ('pg_catalog', 'information_schema')
        group by all""",
    ),
    (
        "m_constraints",
        """select snapshot_id, schema_name, table_name, constraint_name, constraint_type,
          case constraint_type
            when 'PRIMARY KEY' then concat('PRIMARY KEY (', key_columns, ')')
            when 'FOREIGN KEY' then concat('FOREIGN KEY (', key_columns, ') REFERENCES ...')
            when 'UNIQUE' then concat('UNIQUE (', key_columns, ')')
            when 'CHECK' then 'CHECK (...)'
            else constraint_type end definition
        from constraint_keys""",
    ),
    (
        "m_views",
        """select snapshot_id, table_schema schema_name, table_name view_name
        from cat_views where table_schema not in ('pg_catalog', 'information_schema')""",
    ),
    (
        "m_view_columns",
        """select * from m_columns c where exists (select 1 from m_views v
          where v.snapshot_id = c.snapshot_id and v.schema_name = c.schema_name
          and v.view_name = c.table_name)""",
    ),
    (
        "routines",
        """select p.snapshot_id, p.oid, p.prokind, n.nspname schema_name, p.proname,
          case when p.prokind = 'f' then p.return_type end return_type, p.arguments,
          l.lanname as language
        from cat_proc p
        join cat_namespace n on p.snapshot_id = n.snapshot_id and p.pronamespace = n.oid
        join cat_language l on p.snapshot_id = l.snapshot_id and p.prolang = l.oid
        where n.nspname not in ('pg_catalog', 'information_schema')
          and p.prokind in ('f', 'p')""",
    ),
    (
        "m_sequences",
        """select snapshot_id, sequence_schema schema_name, sequence_name, data_type,
          cast(start_value as bigint) start_value, cast(increment as bigint) increment
        from cat_sequences
        where sequence_schema not in ('pg_catalog', 'information_schema')""",
    ),
    # Children and objects.
    (
        "table_children",
        """select snapshot_id, schema_name, table_name object_name, 0 child_rank,
          'COLUMN' child_type, column_name child_name, data_type, is_nullable,
          default_value, ordinal_position, null::boolean is_unique,
          null::varchar constraint_type, null::varchar definition
        from m_columns
        union all
        select snapshot_id, schema_name, table_name, 1, 'INDEX', index_name, null, null,
          null, null, is_unique, null, definition from m_indexes
        union all
        select snapshot_id, schema_name, table_name, 2, 'CONSTRAINT', constraint_name, null,
          null, null, null, null, constraint_type, definition from m_constraints""",
    ),
    (
        "children",
        """select 'TABLE' as type, * from table_children
        union all
        select 'VIEW', c.* from table_children c
        join m_views v on v.snapshot_id = c.snapshot_id and v.schema_name = c.schema_name
          and v.view_name = c.object_name
        where c.child_type = 'COLUMN'""",
    ),
    (
        "grouped",
        """select snapshot_id, type, schema_name, object_name,
          count(*) filter (child_rank = 0) n_columns,
          count(*) filter (child_rank = 1) n_indexes,
          count(*) filter (child_rank = 2) n_constraints,
          string_agg(concat_ws('|', child_type, child_name, coalesce(data_type, '-'),
            coalesce(cast(is_nullable as string), '-'), coalesce(default_value, '<null>'),
            coalesce(cast(ordinal_position as string), '-'),
            coalesce(cast(is_unique as string), '-'), coalesce(constraint_type, '-'),
            coalesce(definition, '-')), ';'
            order by child_rank, ordinal_position, child_name, constraint_type) content
        from children group by all""",
    ),
    (
        "listed",
        """select snapshot_id, 0 kind_rank, type, schema_name, object_name,
          case when n_columns > 0 then 0 when n_indexes > 0 then 1 else 2 end table_rank,
          null::bigint oid, null::varchar return_type, null::varchar arguments,
          null::varchar as language, null::varchar data_type, null::bigint start_value,
          null::bigint increment, n_columns, n_indexes, n_constraints, content
        from grouped where type = 'TABLE'
        union all
        select v.snapshot_id, 1, 'VIEW', v.schema_name, v.view_name, 0, null, null, null,
          null, null, null, null, coalesce(g.n_columns, 0), 0, 0, coalesce(g.content, '')
        from m_views v left join grouped g on g.type = 'VIEW'
          and g.snapshot_id = v.snapshot_id and g.schema_name = v.schema_name
          and g.object_name = v.view_name
        union all
        select snapshot_id, 2, 'FUNCTION', schema_name, proname, 0, oid, return_type,
          arguments, language, null, null, null, 0, 0, 0, ''
        from routines where prokind = 'f'
        union all
        select snapshot_id, 3, 'PROCEDURE', schema_name, proname, 0, oid, null, arguments,
          language, null, null, null, 0, 0, 0, ''
        from routines where prokind = 'p'
        union all
        select snapshot_id, 4, 'SEQUENCE', schema_name, sequence_name, 0, null, null, null,
          null, data_type, start_value, increment, 0, 0, 0, ''
        from m_sequences""",
    ),
    ("objects", "select *, concat(schema_name, '.', object_name) as name from listed"),
    (
        "latest",
        """select * from objects
        qualify row_number() over (partition by snapshot_id, name
          order by kind_rank desc, table_rank desc, arguments desc nulls last,
          language desc nulls last, return_type desc nulls last, schema_name desc,
          object_name desc, oid desc nulls last) = 1""",
    ),
    (
        "modified",
        """select p.source_id, p.target_id, o.name, o.type old_type, n.type new_type,
          o.n_columns old_columns, n.n_columns new_columns, o.snapshot_id old_id,
          n.snapshot_id new_id, o.schema_name old_schema, n.schema_name new_schema,
          o.object_name old_object, n.object_name new_object,
          o.n_columns + o.n_indexes + o.n_constraints old_children,
          n.n_columns + n.n_indexes + n.n_constraints new_children
        from pairs p join latest o on o.snapshot_id = p.source_id
        join latest n on n.snapshot_id = p.target_id and n.name = o.name
        where (o.type, o.schema_name, o.object_name, o.return_type, o.arguments, o.language,
            o.data_type, o.start_value, o.increment, o.content) is distinct from
          (n.type, n.schema_name, n.object_name, n.return_type, n.arguments, n.language,
            n.data_type, n.start_value, n.increment, n.content)""",
    ),
    (
        "one_sided",
        """select p.source_id, p.target_id, 'added' status, o.*
        from pairs p join objects o on o.snapshot_id = p.target_id
        where not exists (select 1 from objects x
          where x.snapshot_id = p.source_id and x.name = o.name)
        union all
        select p.source_id, p.target_id, 'removed', o.*
        from pairs p join objects o on o.snapshot_id = p.source_id
        where not exists (select 1 from objects x
          where x.snapshot_id = p.target_id and x.name = o.name)""",
    ),
    (
        "differing",
        """select source_id, target_id, status from one_sided
        union all select source_id, target_id, 'modified' from modified""",
    ),
    (
        "diff_counts",
        """select p.source_id, p.target_id, s.status, s.status_rank, count(d.status) n
        from pairs p cross join (values ('added', 1), ('removed', 2), ('modified', 3))
          s(status, status_rank)
        left join differing d on d.source_id = p.source_id and d.target_id = p.target_id
          and d.status = s.status
        group by all""",
    ),
    (
        "nodes",
        """select snapshot_id, object_name, type object_type, null::varchar child_type,
          null::varchar child_name from objects
        union all
        select snapshot_id, object_name, type, child_type, child_name from children""",
    ),
    (
        "numbered_nodes",
        """select *, row_number() over (partition by snapshot_id, object_name, object_type,
          child_type, child_name) occurrence from nodes""",
    ),
    (
        "left_nodes",
        """select p.source_id, p.target_id, n.* from pairs p
        join numbered_nodes n on n.snapshot_id = p.source_id""",
    ),
    (
        "right_nodes",
        """select p.source_id, p.target_id, n.* from pairs p
        join numbered_nodes n on n.snapshot_id = p.target_id""",
    ),
    # Report lines. A heading is two lines: the blank one before it and itself.
    (
        "schema_lines",
        """select snapshot_id, 0 part, sub, null::varchar object_name, null::int kind_rank,
          null::int table_rank, null::varchar schema_name, null::varchar arguments,
          null::varchar as language, null::varchar return_type, null::bigint oid,
          0 is_child, null::varchar child_name, null::int child_rank,
          null::int ordinal_position, line
        from (select s.snapshot_id, s.schema_name, count(o.snapshot_id) n from snapshots s
          left join objects o on o.snapshot_id = s.snapshot_id group by all) c,
          lateral (values (0, '=== Database Schema ==='), (1, 'Schema: ' || c.schema_name),
            (2, concat('Total objects: ', cast(c.n as string)))) t(sub, line)
        where line is not null
        union all
        select o.snapshot_id, 1, sub, o.object_name, o.kind_rank, o.table_rank,
          o.schema_name, o.arguments, o.language, o.return_type, o.oid, 0, null, null, null,
          line
        from objects o, lateral (values (0, ''),
          (1, concat('[', o.type, '] ', o.object_name))) t(sub, line)
        union all
        select c.snapshot_id, 1, 0, c.object_name, o.kind_rank, o.table_rank, c.schema_name,
          null, null, null, null, 1, c.child_name, c.child_rank, c.ordinal_position,
          concat('  [', c.child_type, '] ', c.child_name)
        from children c join objects o on o.snapshot_id = c.snapshot_id and o.type = c.type
          and o.schema_name = c.schema_name and o.object_name = c.object_name
        union all
        select snapshot_id, 2, 0, null, null, null, null, null, null, null, null, 0, null,
          null, null, '' from snapshots""",
    ),
    (
        "schema_text",
        """select snapshot_id, row_number() over (partition by snapshot_id order by part,
          object_name, kind_rank, table_rank, schema_name, arguments, language, return_type,
          oid, is_child, child_name, child_rank, ordinal_position, sub) line_no, line
        from schema_lines""",
    ),
    (
        "diff_lines",
        """select source_id, target_id, status_rank, 0 part, sub, null::varchar as name,
          null::int kind_rank, null::int table_rank, null::varchar schema_name,
          null::varchar arguments, null::varchar as language, null::varchar return_type,
          null::bigint oid, 0 as version, 0 is_child, null::int child_rank,
          null::int ordinal_position, null::varchar child_name,
          null::varchar constraint_type, line
        from diff_counts d, lateral (values
          (0, case when status_rank > 1 then '' end),
          (1, case status when 'added' then '=== Added Objects ==='
            when 'removed' then '=== Removed Objects ===' else '=== Modified Objects ===' end),
          (2, case when n = 0 then '(none)' end)) t(sub, line)
        where line is not null
        union all
        select source_id, target_id, case status when 'added' then 1 else 2 end, 1, 0, name,
          kind_rank, table_rank, schema_name, arguments, language, return_type, oid, 0, 0,
          null, null, null, null, concat('- ', type, ': ', object_name)
        from one_sided
        union all
        select d.source_id, d.target_id, case d.status when 'added' then 1 else 2 end, 1, 0,
          d.name, d.kind_rank, d.table_rank, d.schema_name, null, null, null, null, 0, 1,
          c.child_rank, c.ordinal_position, c.child_name, c.constraint_type,
          concat('  - ', c.child_type, ': ', c.child_name)
        from one_sided d join children c on c.snapshot_id = d.snapshot_id
          and c.type = d.type and c.schema_name = d.schema_name
          and c.object_name = d.object_name
        union all
        select source_id, target_id, 3, 1, sub, name, null, null, null, null, null, null,
          null, version, 0, null, null, null, null, line
        from modified m, lateral (values
          (0, 0, concat('Object: ', m.name, ' (', m.old_type, ')')),
          (0, 1, '  --- Old version ---'),
          (0, 2, concat('  type: ', m.old_type)),
          (0, 3, concat('  name: ', m.old_object)),
          (0, 4, case when m.old_children > 0 then '  children:' end),
          (1, 0, '  --- New version ---'),
          (1, 1, concat('  type: ', m.new_type)),
          (1, 2, concat('  name: ', m.new_object)),
          (1, 3, case when m.new_children > 0 then '  children:' end),
          (2, 0, '')) t(version, sub, line)
        where line is not null
        union all
        select v.source_id, v.target_id, 3, 1, sub, v.name, null, null, null, null, null,
          null, null, v.version, 1, c.child_rank, c.ordinal_position, c.child_name,
          c.constraint_type, line
        from (select source_id, target_id, name, 0 as version, old_id id, old_type as type,
            old_schema s, old_object o from modified
          union all
          select source_id, target_id, name, 1, new_id, new_type, new_schema, new_object
          from modified) v
        join children c on c.snapshot_id = v.id and c.type = v.type
          and c.schema_name = v.s and c.object_name = v.o,
          lateral (values (0, concat('    type: ', c.child_type)),
            (1, concat('    name: ', c.child_name))) t(sub, line)""",
    ),
    (
        "diff_text",
        """select source_id, target_id, row_number() over (partition by source_id, target_id
          order by status_rank, part, name, kind_rank, table_rank, schema_name, arguments,
          language, return_type, oid, version, is_child, child_rank, ordinal_position,
          child_name, constraint_type, sub) line_no, line
        from diff_lines""",
    ),
    (
        "node_lines",
        """select snapshot_id, object_name, kind_rank, is_child, child_name, child_rank,
          line, line_no, sum(1 - is_child) over (partition by snapshot_id order by line_no)
            object_place
        from (select *, row_number() over (partition by snapshot_id order by part,
            object_name, kind_rank, table_rank, schema_name, arguments, language,
            return_type, oid, is_child, child_name, child_rank, ordinal_position, sub) line_no
          from schema_lines) t
        where part = 1 and (is_child = 1 or sub = 1)""",
    ),
    (
        "ranked_nodes",
        """select *, row_number() over (partition by snapshot_id, object_name, kind_rank,
          object_no, is_child, child_name, child_rank order by line_no) child_no
        from (select *, object_place - min(object_place) over (partition by snapshot_id,
          object_name, kind_rank) object_no from node_lines) t""",
    ),
    (
        "aligned",
        """select coalesce(l.source_id, r.source_id) source_id,
          coalesce(l.target_id, r.target_id) target_id,
          coalesce(l.object_name, r.object_name) object_name,
          coalesce(l.kind_rank, r.kind_rank) kind_rank,
          coalesce(l.object_no, r.object_no) object_no,
          coalesce(l.is_child, r.is_child) is_child,
          coalesce(l.child_name, r.child_name) child_name,
          coalesce(l.child_rank, r.child_rank) child_rank,
          coalesce(l.child_no, r.child_no) child_no, coalesce(l.line, r.line) line,
          l.line_no left_line, r.line_no right_line
        from (select * from pairs join ranked_nodes on snapshot_id = source_id) l
        full outer join (select * from pairs join ranked_nodes on snapshot_id = target_id) r
          on l.source_id = r.source_id and l.target_id = r.target_id
          and l.object_name = r.object_name and l.kind_rank = r.kind_rank
          and l.object_no = r.object_no and l.is_child = r.is_child
          and l.child_name is not distinct from r.child_name
          and l.child_rank is not distinct from r.child_rank and l.child_no = r.child_no""",
    ),
]

_ONE_SIDED = """select source_id, target_id, name, type, n_columns, n_indexes, n_constraints,
  return_type, arguments, language from one_sided where status = '{status}'"""

# The final select of each query.
_SELECTS: dict[str, str] = {
    "columns": "select * from m_columns",
    "columns_one_schema": "select * from m_columns where schema_name = 's1'",
    "columns_schema_per_snapshot": """select c.* from m_columns c
      join schema_scope s on s.snapshot_id = c.snapshot_id
      where s.schema_name is null or s.schema_name = c.schema_name""",
    "indexes": "select * from m_indexes",
    "constraints": "select * from m_constraints",
    "views": "select * from m_views",
    "view_columns": "select * from m_view_columns",
    "functions": """select snapshot_id, schema_name, proname function_name, return_type,
      arguments, language from routines where prokind = 'f'""",
    "procedures": """select snapshot_id, schema_name, proname procedure_name, arguments,
      language from routines where prokind = 'p'""",
    "sequences": "select * from m_sequences",
    "objects": """select snapshot_id, type, schema_name, object_name, name, return_type,
      arguments, language, data_type, start_value, increment, n_columns, n_indexes,
      n_constraints from objects""",
    "object_children": """select snapshot_id, type, schema_name, object_name, child_type,
      child_name, data_type, is_nullable, default_value, ordinal_position, is_unique,
      constraint_type, definition from children""",
    "object_counts": """select s.snapshot_id, count(o.snapshot_id) n_objects from snapshots s
      left join objects o on o.snapshot_id = s.snapshot_id group by all""",
    "latest": """select snapshot_id, name, type, return_type, arguments, language, n_columns,
      n_indexes, n_constraints from latest""",
    "added": _ONE_SIDED.format(status="added"),
    "removed": _ONE_SIDED.format(status="removed"),
    "modified": """select source_id, target_id, name, old_type, new_type, old_columns,
      new_columns from modified""",
    "diff_summary": "select source_id, target_id, status, n from diff_counts",
    "tree_diff": """select coalesce(l.source_id, r.source_id) source_id,
      coalesce(l.target_id, r.target_id) target_id,
      coalesce(l.object_name, r.object_name) object_name,
      coalesce(l.object_type, r.object_type) object_type,
      coalesce(l.child_type, r.child_type) child_type,
      coalesce(l.child_name, r.child_name) child_name,
      case when r.source_id is null then 'left_only'
        when l.source_id is null then 'right_only' else 'both' end side,
      count(*) n
      from left_nodes l full outer join right_nodes r on l.source_id = r.source_id
        and l.target_id = r.target_id and l.object_name = r.object_name
        and l.object_type = r.object_type
        and l.child_type is not distinct from r.child_type
        and l.child_name is not distinct from r.child_name
        and l.occurrence = r.occurrence
      group by all""",
    "schema_text": "select * from schema_text",
    "diff_text": "select * from diff_text",
    "text_round_trip": "select * from schema_text",
    "diff_text_round_trip": "select * from diff_text",
    "tree_text": """select source_id, target_id, row_number() over (partition by source_id,
        target_id order by object_name, kind_rank, object_no, is_child, child_name nulls first,
        child_rank nulls first, child_no) line_no,
      case when right_line is null then 'left_only' when left_line is null then 'right_only'
        else 'both' end side, left_line, right_line, line from aligned""",
    "diff_summary_scoped": "select source_id, target_id, status, n from diff_counts",
    "schema_text_scoped": "select * from schema_text",
    "catalog_faults": " union all ".join(
        f"""select snapshot_id, '{relation}' relation, '{field}' field, count(*) n_rows,
        count(*) - count({field}) n_missing from {source} group by snapshot_id"""
        for relation, source, fields in [
            ("columns", "cat_columns where table_schema not in ('pg_catalog', 'information_schema')",
             ["table_name", "column_name", "data_type", "is_nullable", "ordinal_position"]),
            ("indexes", "cat_indexes where schemaname not in ('pg_catalog', 'information_schema')",
             ["tablename", "indexname", "indexdef"]),
            ("table_constraints",
             "cat_table_constraints where table_schema not in ('pg_catalog', 'information_schema')",
             ["table_name", "constraint_name", "constraint_type"]),
            ("views", "cat_views where table_schema not in ('pg_catalog', 'information_schema')",
             ["table_name"]),
            ("sequences",
             "cat_sequences where sequence_schema not in ('pg_catalog', 'information_schema')",
             ["sequence_name", "data_type", "start_value", "increment"]),
            ("proc", "(select snapshot_id, proname, arguments, language as lanname from routines) t",
             ["proname", "arguments", "lanname"]),
            ("proc", "routines where prokind = 'f'", ["return_type"]),
        ]
        for field in fields
    ),
}

# Relations that several others read: computed once.
_SHARED = {
    "m_columns", "m_constraints", "table_children", "children", "objects", "latest", "modified",
    "one_sided", "schema_lines", "schema_text", "ranked_nodes",
}
# What names the schema of an entry, for queries restricted to a schema per snapshot.
_SCHEMA_COLUMNS = {
    "cat_columns": "table_schema", "cat_indexes": "schemaname",
    "cat_table_constraints": "table_schema", "cat_views": "table_schema",
    "cat_namespace": "nspname", "cat_sequences": "sequence_schema",
}
_SCOPED = {"diff_summary_scoped", "schema_text_scoped"}


def _scoped_relations() -> list[tuple[str, str]]:
    found = []
    for name, sql in _RELATIONS:
        if name == "snapshots":
            sql = "select r_regionkey snapshot_id, r_name name, schema_name from region join schema_scope on snapshot_id = r_regionkey"
        if name not in _SCHEMA_COLUMNS:
            found.append((name, sql))
            continue
        found.append((f"all_{name}", sql))
        found.append((name, f"""select a.* from all_{name} a
          join schema_scope s on s.snapshot_id = a.snapshot_id
          where s.schema_name is null or s.schema_name = a.{_SCHEMA_COLUMNS[name]}"""))
    return found


def _with(relations: list[tuple[str, str]], final: str) -> str:
    """The query with the relations it needs, directly or through others."""
    used, text = [], final
    for name, sql in reversed(relations):
        if re.search(rf"\b{name}\b", text):
            used.append(f"{name} as {'materialized ' if name in _SHARED else ''}({sql})")
            text += f"\n{sql}"
    return f"with {',\n'.join(reversed(used))}\n{final}"


def oracle_sql() -> dict[str, str]:
    return {
        name: _with(_scoped_relations() if name in _SCOPED else _RELATIONS, final)
        for name, final in _SELECTS.items()
    }
