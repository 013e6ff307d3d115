"""The registered queries in SQL, on the given tables."""

from __future__ import annotations

AS_OF = 1705000000
NOW = "1800000000::bigint"
LATER = "1800000060::bigint"

M = "(epoch_us(ts) // 1000000)"

# Derived tables, each with those it is built on before it.
TABLES = {
    "files": f"""
        select event_id as row_seq,
               '/data/' || event_type || '/user_' || user_id || '.dat' as path,
               'v' || event_id as version_id, sha256(props) as sha256,
               cast(floor(value * 100) as bigint) as size,
               {M} as last_modified_at, {M} + 60 as created_at,
               case when event_id % 7 = 0 then {M} + 86400 end as deleted_at
        from events""",
    "latest": """
        select * exclude (rn) from (
          select *, row_number() over (partition by path order by last_modified_at desc, row_seq desc) as rn
          from files) where rn = 1""",
    "as_of": f"""
        select path, size, last_modified_at, version_id from (
          select *, row_number() over (partition by path order by last_modified_at desc, row_seq desc) as rn
          from files where last_modified_at <= {AS_OF})
        where rn = 1 and (deleted_at is null or deleted_at > {AS_OF})""",
    "inventory": """
        select l.path,
               l.size + case when l.row_seq % 3 = 0 then 1 else 0 end as size,
               l.last_modified_at + case when l.row_seq % 3 = 0 then 10 else 0 end as last_modified_at
        from latest l join events e on e.event_id = l.row_seq where e.user_id % 4 <> 0""",
    "changed": """
        select i.* from inventory i where not exists (
          select 1 from files f where f.path = i.path and f.size = i.size
            and f.last_modified_at = i.last_modified_at and f.deleted_at is null)""",
    "gone": """
        select path from latest where deleted_at is null and path not in (select path from inventory)""",
    "runs": """
        select 1000000000 + o_orderkey * 100 as started_at,
               1000000000 + o_orderkey * 100 + cast(floor(o_totalprice) as bigint) % 97 as ended_at,
               case when o_orderstatus = 'F' then 'restore' else 'backup' end as type,
               nullif(trim(case when o_orderpriority = '5-LOW' then '  ' else o_orderpriority end), '') as details,
               1000000000 + o_orderkey * 100 as created_at
        from orders""",
    "manifest": """
        select 'bkt' as bucket, path as key,
               case when row_seq % 11 = 0 then 'missing' else version_id end as version_id,
               case when row_seq % 13 = 0 then repeat('0', 64) else sha256 end as computed_sha256
        from files""",
    "docs": """
        select doc_id, '/docs/' || source || '/' || lang || '/' || doc_id || '.txt' as path,
               'd' || doc_id as version_id, text, cast(strlen(text) as bigint) as size,
               greatest(1, (strlen(text) + 1023) // 1024)::bigint as n_chunks
        from documents""",
    "doc_chunks": """
        select *, i as chunk_index, i = n_chunks - 1 as is_last,
               least(1024, size - i * 1024) as n_bytes
        from (select *, unnest(range(n_chunks)) as i from docs)""",
    "sizes": """
        select l_orderkey, sum(cast(floor(l_extendedprice * 300) as bigint))::bigint as size
        from lineitem group by l_orderkey""",
    "stored": """
        select l_orderkey, size,
               49 + size + 16 * greatest(1, (size + 16777215) // 16777216) as stored from sizes""",
    "heads": """
        select '/orders/' || o_orderkey as key, o_orderkey, o_orderstatus as s,
               case when o_orderkey % 17 = 0 then 'access denied' end as denied,
               o_orderstatus = 'F' as restored,
               case when o_orderstatus = 'F' and o_orderkey % 4 <> 2 then epoch_us(o_orderdate) // 1000000 end as expiry,
               case when o_orderstatus = 'F' and o_orderkey % 4 <> 2 then
                 case when o_orderkey % 4 = 0 then 'GMT' else 'UTC' end end as zone,
               case when o_orderstatus = 'P' then 'object is not archived' end as error
        from orders""",
    "status": """
        select key, version_id, coalesce(error is null and restored, false) as restored,
               case when error is null then expiry end as expiry, error,
               case when error is not null then 'Error retrieving status: ' || error
                    when restored then 'Restored' || coalesce(', Expires on ' ||
                      strftime(make_timestamp(expiry * 1000000), '%Y-%m-%d %H:%M:%S') || ' ' || zone, '')
                    else 'Not Restored' end as status
        from (select key, case when o_orderkey % 23 = 0 then 'gone' else 'v' || o_orderkey end as version_id,
                     restored, expiry, zone,
                     case when o_orderkey % 23 = 0 then 'no response for this version'
                          else coalesce(denied, error) end as error
              from heads)""",
    "new_versions": """
        select path, version_id, sha256, size, last_modified_at from (
          select path, case when row_seq % 5 = 0 then version_id else 'n' || row_seq end as version_id,
                 case when row_seq % 11 = 0 then upper(sha256) else sha256 end as sha256,
                 case when row_seq % 13 = 0 then -1 else size end as size,
                 last_modified_at + row_seq % 2 + d as last_modified_at
          from files join (values (0, 0, 0), (0, 0, 1), (0, 0, 2), (5, 1, 0), (0, 1, 1)) v(d, copy, turn)
            on row_seq % 3 = turn)""",
    "folded": """
        select *, count(*) as copies,
               list_filter([case when not regexp_matches(sha256, '^[0-9a-f]{64}$') then 'sha256' end,
                            case when size < 0 then 'size' end], lambda x: x is not null) as reasons
        from new_versions group by all""",
    "ranked": """
        select f.*, case when len(reasons) = 0 then row_number() over (
                 partition by path, version_id, len(reasons) = 0
                 order by last_modified_at, size, sha256) end as rn,
               exists (select 1 from files g where g.path = f.path and g.version_id = f.version_id) as known
        from folded f""",
    "unchecked": """
        select row_seq, regexp_replace(case when row_seq % 29 = 0 then '' else path end, 'user_[0-9]+', 'user_1') as path,
               'v' || (row_seq % 997) as version_id,
               case row_seq % 31 when 0 then upper(sha256) when 1 then substr(sha256, 2) else sha256 end as sha256,
               case when row_seq % 37 = 0 then null when row_seq % 41 = 0 then -size - 1 else size end as size,
               case when row_seq % 43 = 0 then 0 else last_modified_at end as last_modified_at,
               created_at, case when row_seq % 47 = 0 then -1 else deleted_at end as deleted_at
        from files""",
    "checked": """
        select *, list_filter([
                 case when path = '' then 'path' end,
                 case when not regexp_matches(sha256, '^[0-9a-f]{64}$') then 'sha256' end,
                 case when size is null or size < 0 then 'size' end,
                 case when last_modified_at <= 0 then 'last_modified_at' end,
                 case when deleted_at <= 0 then 'deleted_at' end], lambda x: x is not null) as reasons
        from unchecked""",
    "placed": """
        select *, case when len(reasons) = 0 then row_number() over (
                 partition by path, version_id, len(reasons) = 0 order by row_seq) end as rn
        from checked""",
    "colliding": """
        select 1000000000 + o_orderkey % 5003 as started_at,
               case when o_orderkey % 19 = 0 then 0 else 1000000000 + o_orderkey % 5003
                 + cast(floor(o_totalprice) as bigint) % 97 end as ended_at,
               case o_orderstatus when 'F' then 'restore' when 'O' then 'backup' else 'other' end as type,
               o_orderpriority || ' ' || o_orderkey as details, o_orderkey as created_at,
               case when o_orderkey % 4 = 0 then 2 else 1 end as copies
        from orders""",
    "events_checked": """
        select *, list_filter([case when ended_at <= 0 then 'ended_at' end,
                               case when type = 'other' then 'type' end], lambda x: x is not null) as reasons
        from colliding""",
    "events_placed": """
        select *, case when len(reasons) = 0 then row_number() over (
                 partition by started_at, len(reasons) = 0 order by ended_at, type, details) end as rn
        from events_checked""",
    "audited": """
        select path, n_chunks, doc_id % 6 as kind,
               case when doc_id % 6 = 1 then 1 else 0 end as dropped,
               case when doc_id % 6 = 4 then 1 else 0 end as copied,
               case when doc_id % 6 = 5 and n_chunks > 1 then 1 else 0 end as alien
        from docs""",
    "walk": "select doc_id, path, text, size, 1700000000 + doc_id as last_modified_at from docs",
    "doc_catalog": """
        select doc_id as row_seq, case when doc_id % 5 = 4 then '/docs/gone/' || doc_id else path end as path,
               version_id, sha256(text) as sha256, size,
               1700000000 + doc_id - case when doc_id % 3 = 1 then 10 else 0 end as last_modified_at,
               1700000100 as created_at
        from docs where doc_id % 3 <> 2""",
    "doc_changed": "select * from walk where doc_id % 3 <> 0 or doc_id % 5 = 4",
    "restored": """
        select path as key, case
            when doc_id % 24 in (12, 13) then 'not found'
            when doc_id % 24 >= 14 and doc_id % 10 = 0 then 'undecryptable'
            when doc_id % 24 = 1 then 'undecryptable'
            when doc_id % 24 = 2 then 'unsupported version'
            when doc_id % 24 = 3 then 'invalid time cost'
            when doc_id % 24 = 4 then 'invalid memory cost'
            when doc_id % 24 = 5 then 'invalid parallelism'
            when doc_id % 24 = 6 then 'invalid chunk size'
            when doc_id % 24 = 7 then 'short header'
            when doc_id % 24 = 8 then 'no chunk data'
            when doc_id % 24 = 9 then 'truncated'
            when doc_id % 24 = 10 then 'too short'
            when doc_id % 17 = 0 then 'missing'
            when doc_id % 13 = 0 then 'mismatch'
            else 'ok' end as status
        from docs""",
    "header_reasons": """
        select path, doc_id, n_chunks, size, case doc_id % 12
            when 1 then 'bad magic' when 2 then 'unsupported version' when 3 then 'invalid time cost'
            when 4 then 'invalid memory cost' when 5 then 'invalid parallelism'
            when 6 then 'invalid chunk size' when 7 then 'short header' when 8 then 'no chunk data'
            when 9 then 'truncated' when 10 then 'short header' end as reason
        from docs""",
}

NEEDS = {
    "latest": ["files"],
    "as_of": ["files"],
    "inventory": ["latest"],
    "changed": ["inventory"],
    "gone": ["inventory"],
    "manifest": ["files"],
    "doc_chunks": ["docs"],
    "stored": ["sizes"],
    "status": ["heads"],
    "new_versions": ["files"],
    "folded": ["new_versions"],
    "ranked": ["folded"],
    "unchecked": ["files"],
    "checked": ["unchecked"],
    "placed": ["checked"],
    "events_checked": ["colliding"],
    "events_placed": ["events_checked"],
    "audited": ["docs"],
    "walk": ["docs"],
    "doc_catalog": ["docs"],
    "doc_changed": ["walk"],
    "restored": ["docs"],
    "header_reasons": ["docs"],
}


def _with(*names: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "with " + ", ".join(f"{name} as ({TABLES[name]})" for name in order) + " "


def _utc(column: str) -> str:
    return f"strftime(make_timestamp({column} * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC'"


_EVENT_LINE = (
    f"'ID: ' || started_at || ', Started At: ' || {_utc('started_at')} || ', Ended At: ' || "
    f"{_utc('ended_at')} || ', Details: ' || coalesce(details, 'N/A') as value"
)
_FILE_LINE = (
    "'Path: ' || path || ', Size: ' || size || ' bytes, LastModified At: ' || "
    f"{_utc('last_modified_at')} as value"
)
_ROW_SEQ = (
    "(select max(row_seq) from files) + 1 + ('0x' || substr(digest, 1, 4))::bigint + 65536 * "
    "(row_number() over (partition by substr(digest, 1, 4) order by path, version_id) - 1)"
)
_KEY = "case ('0x' || substr(computed_sha256, 1, 2))::int % 6"
_ADDRESSES = """select row_seq, case row_seq % 6
    when 0 then 's3://bkt' || path when 1 then 's3://other' || path when 2 then 'http://bkt' || path
    when 3 then 's3://bkt' when 4 then 's3://bkt/' || path else 's3://bkt' || path || '/' end as uri,
    case row_seq % 6 when 0 then 'bkt' when 1 then 'other' end as bucket,
    case when row_seq % 6 < 2 then substr(path, 2) end as key,
    case row_seq % 6 when 2 then 'invalid S3 path: missing ''s3://'' prefix'
      when 3 then 'invalid S3 path: must contain bucket and key'
      when 4 then 'invalid S3 path: contains empty segments'
      when 5 then 'invalid S3 path: contains empty segments' {other} end as error from files"""
_HEADER = (
    "upper(hex(encode('CATALOG-TEST')) || '01' || md5('salt' || doc_id) || '00000003' || '00010000' "
    "|| '04' || substr(md5('nonce' || doc_id), 1, 14) || '00000400')"
)
_PIECE = "unhex(substr(hex(encode(text)), 2048 * chunk_index + 1, 2 * n_bytes))"
_FULL = "row_seq, path, version_id, sha256, size, last_modified_at, created_at, deleted_at"

ORACLE = {
    "compact_catalog": _with("files") + "select * from files",
    "adopt_snapshot": _with("files", "runs")
    + "select *, (select count(*) from runs) as n_events from files",
    "read_catalog": _with("files") + "select * from files where path like '/data/view/%'",
    "read_manifest": _with("files")
    + "select 'bkt' as bucket, path as key, version_id from files where row_seq % 9 not in (1, 3, 4)",
    "read_manifest_rejects": _with("files")
    + """select case row_seq % 9 when 3 then 'bkt,' || path else 'bkt,' || path || ',' || version_id || ',x' end as line,
         'must be in the format: bucket, key, version_id' as reason from files where row_seq % 9 in (3, 4)""",
    "read_chunks": _with("docs") + "select path, n_chunks, size as n_bytes, 1::bigint as n_last from docs",
    "append_versions": _with("ranked")
    + f"""select * from files union all
          select {_ROW_SEQ} as row_seq, path, version_id, sha256, size, last_modified_at,
                 {NOW} as created_at, null as deleted_at
          from (select *, md5(path || chr(0) || version_id) as digest from ranked where rn = 1 and not known)""",
    "append_versions_rejects": _with("ranked")
    + """select path, version_id, sha256, size, last_modified_at,
                (case when rn = 1 and not known then copies - 1 else copies end)::bigint as copies,
                case when len(reasons) > 0 then array_to_string(reasons, ',') else 'duplicate key' end as reasons
         from ranked where not (coalesce(rn = 1, false) and not known) or copies > 1""",
    "append_event": _with("runs") + "select * from runs union all select 2, 9, 'backup', null, 9",
    "append_events": _with("runs")
    + """select * from runs where created_at % 300 = 0 union all
         select started_at, ended_at, type, case when created_at % 400 <> 0 then ' ' || details end, created_at
         from runs where created_at % 300 <> 0""",
    "to_manifest": _with("as_of") + "select 'bkt,' || path || ',' || version_id as value from as_of",
    "format_files": _with("as_of") + f"select {_FILE_LINE} from as_of",
    "format_versions": _with("files")
    + f"""select 'Size: ' || size || ' bytes, LastModified At: ' || {_utc('last_modified_at')}
          || ', SHA256: ' || sha256 as value from files""",
    "format_events": _with("runs") + f"select {_EVENT_LINE} from runs where type = 'backup'",
    "write_listing": _with("runs") + f"select {_EVENT_LINE} from runs where type = 'restore'",
    "write_listing_empty": _with("runs")
    + "select 'No backups found' as value where (select count(*) from runs where started_at < 0) = 0",
    "publish_catalog": _with("files") + "select * from files",
    "restore_layout": _with("manifest")
    + f"""select {_KEY} when 0 then key when 1 then '/' || key when 2 then key || '/../z' when 3 then '../..' || key
            when 4 then replace(key, '/user', '/./user/') else '/data/..' end as key, version_id,
          {_KEY} when 0 then '/restore/to' || key when 1 then '/restore/to' || key
            when 2 then '/restore/to' || regexp_replace(key, '[^/]*$', 'z') when 3 then null
            when 4 then '/restore/to' || replace(key, '/user', '/user/') else null end as out_path,
          {_KEY} when 3 then 'key leaves the output directory' when 5 then 'key names no file' end as reason
          from manifest""",
    "filter_prefix": _with("files") + "select * from files where lower(path) like '/data/view/user_1%'",
    "filter_prefix_literal": _with("files") + "select * from files where starts_with(path, '/data/view/user_1')",
    "live_only": _with("latest") + "select * from latest where deleted_at is null",
    "live_only_as_of": _with("files")
    + f"select * from files where deleted_at is null or deleted_at > {AS_OF}",
    "filter_events": _with("runs") + "select * from runs where type = 'restore'",
    "parse_object_uri": _with("files") + _ADDRESSES.format(other=""),
    "check_bucket": _with("files")
    + _ADDRESSES.format(other="when 1 then 'bucket does not match the configured bucket'"),
    "detect_changed": _with("changed") + "select * from changed",
    "detect_deleted": _with("gone") + "select * from gone",
    "lookup_checksums": _with("manifest")
    + """select m.bucket, m.key, m.version_id, f.sha256 from manifest m
         left join files f on f.path = m.key and f.version_id = m.version_id""",
    "verify_checksums": _with("manifest")
    + """select m.key, m.version_id,
                case when f.sha256 is null then 'missing' when f.sha256 = m.computed_sha256 then 'ok' else 'mismatch' end as status,
                f.sha256 as expected_sha256,
                case when f.sha256 is not null then m.computed_sha256 end as computed_sha256
         from manifest m left join files f on f.path = m.key and f.version_id = m.version_id""",
    "mark_deleted": _with("gone", "files")
    + f"""select f.row_seq, f.path, f.version_id, f.sha256, f.size, f.last_modified_at, f.created_at,
            case when f.row_seq in (select row_seq from latest l join gone g on g.path = l.path)
                 then {NOW} else f.deleted_at end as deleted_at from files f""",
    "restore_status": _with("status") + "select * from status",
    "file_exists": _with("inventory")
    + """select *, exists (select 1 from files f where f.path = i.path and f.size = i.size
            and f.last_modified_at = i.last_modified_at and f.deleted_at is null) as "exists"
         from inventory i""",
    "status_summary": _with("status")
    + """select count(*) filter (error is null and restored) as restored,
                count(*) filter (error is null and not restored) as not_restored,
                count(*) filter (error is not null) as errors from status""",
    "run_summary": _with("changed", "gone")
    + """select (select count(*) from changed) as changed,
                (select count(*) from changed where size % 5 <> 0) as inserted,
                (select count(*) from gone) as deleted,
                (select count(*) from changed where size % 5 = 0) as failed, 60::bigint as duration""",
    "current_schema_version": "select max(o_orderkey % 2 + 1)::bigint as version from orders",
    "file_digests": _with("docs") + "select path, size, sha256(text) as sha256 from docs",
    "latest_versions": _with("latest") + "select * from latest",
    "files_as_of": _with("as_of") + "select * from as_of",
    "files_as_of_prefix": _with("as_of") + "select * from as_of where lower(path) like '/data/view/user_1%'",
    "list_events": _with("runs")
    + "select started_at, ended_at, details from runs where type = 'backup' order by started_at desc",
    "list_versions": _with("files")
    + """select last_modified_at, size, sha256 from files where path = '/data/view/user_10.dat'
         order by last_modified_at desc, row_seq desc""",
    "sample_live": _with("latest")
    + """select path, size, last_modified_at, version_id from latest where deleted_at is null
         order by md5('7:' || path), path limit 100""",
    "sample_live_count": _with("latest")
    + "select least(100, count(*))::bigint as n from latest where deleted_at is null",
    "list_files_multi": _with("as_of")
    + """select a.* from as_of a join (values ('/data/view%'), ('/data/view/user_1%'), ('/data/click%')) v(p)
         on lower(a.path) like v.p""",
    "walked_paths": _with("inventory") + "select distinct path from inventory",
    "parse_restore_header": _with("heads") + "select key, restored, expiry, zone, error from heads",
    "status_text": _with("status") + "select key || ': ' || status as value from status",
    "upload_parts": _with("stored")
    + """select l_orderkey, stored, part_size, (stored + part_size - 1) // part_size as part_count from (
           select *, case when stored < 16777216 then 5242880 when stored < 104857600 then 8388608
             when stored < 1073741824 then 16777216 else 33554432 end::bigint as part_size from stored)
         """,
    "n_chunks": _with("docs") + "select path, n_chunks from docs",
    "sealed_size": _with("stored") + "select l_orderkey, stored as sealed_size from stored",
    "epoch_text": _with("files")
    + "select row_seq, strftime(make_timestamp(last_modified_at * 1000000), '%Y-%m-%d %H:%M:%S') as modified from files",
    "hex_digest": _with("docs") + "select path, sha256(text) as sha256 from docs",
    "plan_headers": _with("docs") + f"select path, n_chunks, {_HEADER} as header from docs",
    "plan_headers_random": _with("docs")
    + """select count(*) as n, count(*) as salts, count(*) as prefixes, count(*) as versions,
                count(*) as whole from docs""",
    "chunk_nonces": _with("doc_chunks")
    + """select path, chunk_index, upper(substr(md5('nonce' || doc_id), 1, 14)) || printf('%08X', chunk_index)
           || case when is_last then '01' else '00' end as nonce from doc_chunks""",
    "seal_chunks": _with("doc_chunks")
    + f"""select path, chunk_index, is_last, n_bytes + 16 as n_bytes, sha256({_PIECE}) as chunk_sha256
          from doc_chunks""",
    "open_chunks": _with("docs") + "select path, size, sha256(text) as sha256 from docs",
    "verify_sealed": _with("docs") + "select path, 'ok' as status from docs",
    "verify_sealed_chunks": _with("docs")
    + """select doc_id % 7 = 0 as spoilt, case when doc_id % 7 = 0 then 'mismatch' else 'ok' end as status,
                count(*) as n from docs group by all""",
    "parse_headers": _with("header_reasons")
    + """select path, reason, case when reason is null then n_chunks end as n_chunks,
                case when reason is null then size end as size from header_reasons""",
    "detect_format": _with("header_reasons")
    + """select path, case doc_id % 12 when 1 then 'legacy' when 10 then null else 'v1' end as format
         from header_reasons""",
    "split_container": _with("header_reasons")
    + """select path, n_chunks, size + 16 * n_chunks as n_bytes, 1::bigint as n_last
         from header_reasons where reason is null""",
    "split_container_rejects": _with("header_reasons")
    + "select path, reason from header_reasons where reason is not null",
    "split_legacy": _with("docs")
    + """select path, (n_chunks - case when doc_id % 10 = 0 then 1 else 0 end)::bigint as n_frames,
                case when doc_id % 10 = 0 then 'truncated' end as reason from docs""",
    "open_legacy": _with("docs")
    + "select path, case when doc_id % 10 <> 0 then sha256(text) end as sha256 from docs",
    "audit_containers": _with("audited")
    + """select path, n_chunks as chunks_expected, n_chunks - dropped + copied + alien as chunks_seen,
                (case when kind = 2 and n_chunks > 1 then 2 when kind = 3 then 1 else 0 end + alien)::bigint as chunks_failed,
                copied::bigint as chunks_repeated, dropped::bigint as chunks_missing,
                dropped + copied + alien = 0 and not (kind = 3 or (kind = 2 and n_chunks > 1)) as intact
         from audited""",
    "scan_inventory": _with("docs")
    + "select substr(path, 6) as path, size, 1799999000::bigint as last_modified_at from docs",
    "backup_run_from_files": _with("docs")
    + f"""select substr(path, 6) as path, sha256(text) as sha256, size,
                 1799999000::bigint as last_modified_at, {LATER} as created_at from docs""",
    "read_containers": _with("docs")
    + "select substr(path, 6) as path, 49 + size + 16 * n_chunks as total_size from docs",
    "split_container_forged": _with("docs")
    + """select path, case when doc_id % 5 <> 0 then n_chunks end as n_chunks,
                case when doc_id % 5 <> 0 then size + 16 * n_chunks end as n_bytes from docs""",
    "restore_run_to_files": _with("docs")
    + "select substr(path, 6) as path, 'ok' as status, size from docs",
    "backup_run_repeated": _with("docs")
    + f"""select path, sha256(text) as sha256, size, 1700000000 + doc_id as last_modified_at,
                 {LATER} as created_at, null::bigint as deleted_at, 1::bigint as n_events,
                 count(*) over () as n_objects
          from docs where doc_id % 7 <> 0""",
    "backup_run": _with("doc_changed", "doc_catalog")
    + """select (select count(*) from doc_changed) as changed,
                (select count(*) from doc_changed where doc_id % 7 <> 0) as inserted,
                (select count(*) from doc_catalog where path like '/docs/gone/%') as deleted,
                (select count(*) from doc_changed where doc_id % 7 = 0) as failed, 60::bigint as duration""",
    "backup_run_catalog": _with("doc_changed", "doc_catalog")
    + f"""select path, sha256, size, last_modified_at, created_at,
                 case when path like '/docs/gone/%' then {LATER} end as deleted_at from doc_catalog
          union all select path, sha256(text), size, last_modified_at, {LATER}, null
          from doc_changed where doc_id % 7 <> 0""",
    "restore_run": _with("restored") + "select * from restored",
    "restore_run_summary": _with("restored")
    + """select count(*) as files, count(*) filter (status = 'ok') as restored,
                count(*) filter (status <> 'ok') as failed, 5::bigint as duration from restored""",
    "validate_files": _with("placed") + f"select {_FULL} from placed where rn = 1",
    "validate_files_rejects": _with("placed")
    + """select row_seq, case when len(reasons) > 0 then array_to_string(reasons, ',') else 'duplicate key' end as reasons
         from placed where coalesce(rn > 1, true)""",
    "validate_events": _with("events_placed")
    + "select started_at, ended_at, type, details, created_at from events_placed where rn = 1",
    "validate_events_rejects": _with("events_placed")
    + """select created_at, (case when rn = 1 then copies - 1 else copies end)::bigint as copies,
                case when len(reasons) > 0 then array_to_string(reasons, ',') else 'duplicate key' end as reasons
         from events_placed where coalesce(rn > 1, true) or copies > 1""",
    "upgrade_catalog": _with("files")
    + "select * replace (cast(null as bigint) as deleted_at) from files",
    "ingest_stream": _with("walk", "doc_catalog")
    + f"""select path, version_id, sha256, size, last_modified_at,
                 case when path like '/docs/gone/%' then {LATER} end as deleted_at from doc_catalog
          union all select path, 's' || doc_id, sha256(path), size, last_modified_at, null
          from walk where doc_id % 3 <> 0""",
    "ingest_stream_summary": _with("walk", "doc_catalog")
    + """select (select count(*) from walk) as changed,
                (select count(*) from walk where doc_id % 3 <> 0) as inserted,
                (select count(*) from doc_catalog where path like '/docs/gone/%') as deleted,
                0::bigint as failed, 60::bigint as duration""",
}
