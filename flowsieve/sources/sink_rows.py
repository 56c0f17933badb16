"""Built-in sinks per category: (name, watched argument positions, label of the sanitizers it accepts)."""

from __future__ import annotations

# Sinks in the order of their categories; position 0 means any argument, None accepts no sanitizer.
SINK_ROWS: dict[str, list[tuple[str, list[int], str | None]]] = {
    "XSS": [
        ("echo", [0], "XSS"),
        ("print", [1], "XSS"),
        ("print_r", [1], "XSS"),
        ("exit", [1], "XSS"),
        ("die", [1], "XSS"),
        ("printf", [0], "XSS"),
        ("vprintf", [0], "XSS"),
        ("trigger_error", [1], "XSS"),
        ("user_error", [1], "XSS"),
        ("odbc_result_all", [2], "XSS"),
        ("ovrimos_result_all", [2], "XSS"),
        ("ifx_htmltbl_result", [2], "XSS"),
    ],
    "CODE": [
        ("assert", [1], None),
        ("create_function", [1, 2], None),
        ("eval", [1], None),
        ("mb_ereg_replace", [1, 2], "PREG"),
        ("mb_eregi_replace", [1, 2], "PREG"),
        ("preg_filter", [1, 2], "PREG"),
        ("preg_replace", [1, 2], "PREG"),
        ("preg_replace_callback", [1], "PREG"),
    ],
    "EXEC": [
        ("backticks", [1], "SYSTEM"),
        ("exec", [1], "SYSTEM"),
        ("expect_popen", [1], "SYSTEM"),
        ("passthru", [1], "SYSTEM"),
        ("pcntl_exec", [1], "SYSTEM"),
        ("popen", [1], "SYSTEM"),
        ("proc_open", [1], "SYSTEM"),
        ("shell_exec", [1], "SYSTEM"),
        ("system", [1], "SYSTEM"),
        ("mail", [5], None),
        ("mb_send_mail", [5], None),
        ("w32api_invoke_function", [1], None),
        ("w32api_register_function", [2], None),
    ],
    "DATABASE": [
        ("dba_open", [1], None),
        ("dba_popen", [1], None),
        ("dba_insert", [1, 2], None),
        ("dba_fetch", [1], None),
        ("dba_delete", [1], None),
        ("dbx_query", [2], "SQL"),
        ("odbc_do", [2], "SQL"),
        ("odbc_exec", [2], "SQL"),
        ("odbc_execute", [2], "SQL"),
        ("db2_exec", [2], "SQL"),
        ("db2_execute", [2], "SQL"),
        ("fbsql_db_query", [2], "SQL"),
        ("fbsql_query", [1], "SQL"),
        ("ibase_query", [2], "SQL"),
        ("ibase_execute", [1], "SQL"),
        ("ifx_query", [1], "SQL"),
        ("ifx_do", [1], "SQL"),
        ("ingres_query", [2], "SQL"),
        ("ingres_execute", [2], "SQL"),
        ("ingres_unbuffered_query", [2], "SQL"),
        ("msql_db_query", [2], "SQL"),
        ("msql_query", [1], "SQL"),
        ("msql", [2], "SQL"),
        ("mssql_query", [1], "SQL"),
        ("mssql_execute", [1], "SQL"),
        ("mysql_db_query", [2], "SQL"),
        ("mysql_query", [1], "SQL"),
        ("mysql_unbuffered_query", [1], "SQL"),
        ("mysqli_stmt_execute", [1], "SQL"),
        ("mysqli_query", [2], "SQL"),
        ("mysqli_real_query", [1], "SQL"),
        ("mysqli_master_query", [2], "SQL"),
        ("oci_execute", [1], None),
        ("ociexecute", [1], None),
        ("ovrimos_exec", [2], "SQL"),
        ("ovrimos_execute", [2], "SQL"),
        ("ora_do", [2], None),
        ("ora_exec", [1], None),
        ("pg_query", [2], "SQL"),
        ("pg_send_query", [2], "SQL"),
        ("pg_send_query_params", [2], "SQL"),
        ("pg_send_prepare", [3], "SQL"),
        ("pg_prepare", [3], "SQL"),
        ("sqlite_open", [1], "SQL"),
        ("sqlite_popen", [1], "SQL"),
        ("sqlite_array_query", [1, 2], "SQL"),
        ("arrayQuery", [1, 2], "SQL"),
        ("singleQuery", [1], "SQL"),
        ("sqlite_query", [1, 2], "SQL"),
        ("sqlite_exec", [1, 2], "SQL"),
        ("sqlite_single_query", [2], "SQL"),
        ("sqlite_unbuffered_query", [1, 2], "SQL"),
        ("sybase_query", [1], "SQL"),
        ("sybase_unbuffered_query", [1], "SQL"),
    ],
    "SSRF": [
        ("get_headers", [0], None),
    ],
    "HTTP_HEADER": [
        ("header", [1], None),
    ],
    "POP": [
        ("unserialize", [1], None),
        ("yaml_parse", [1], None),
    ],
    "OTHER": [
        ("dl", [1], None),
        ("ereg", [2], None),
        ("eregi", [2], None),
        ("ini_set", [1, 2], None),
        ("ini_restore", [1], None),
        ("runkit_constant_redefine", [1, 2], None),
        ("runkit_method_rename", [1, 2, 3], None),
        ("sleep", [1], None),
        ("usleep", [1], None),
        ("extract", [1], None),
        ("mb_parse_str", [1], None),
        ("parse_str", [1], None),
        ("putenv", [1], None),
        ("set_include_path", [1], None),
        ("apache_setenv", [1, 2], None),
        ("define", [1], None),
        ("is_a", [1], None),
    ],
    "CONNECT": [
        ("curl_setopt", [2, 3], None),
        ("curl_setopt_array", [2], None),
        ("cyrus_query", [2], None),
        ("error_log", [3], None),
        ("fsockopen", [1], None),
        ("ftp_chmod", [2, 3], None),
        ("ftp_exec", [2], None),
        ("ftp_delete", [2], None),
        ("ftp_fget", [3], None),
        ("ftp_get", [2, 3], None),
        ("ftp_nlist", [2], None),
        ("ftp_nb_fget", [3], None),
        ("ftp_nb_get", [2, 3], None),
        ("ftp_nb_put", [2], None),
        ("ftp_put", [2, 3], None),
        ("get_headers", [1], None),
        ("imap_open", [1], None),
        ("imap_mail", [1], None),
        ("mail", [1, 4], None),
        ("mb_send_mail", [1, 4], None),
        ("ldap_connect", [1], None),
        ("msession_connect", [1], None),
        ("pfsockopen", [1], None),
        ("session_register", [0], None),
        ("socket_bind", [2], None),
        ("socket_connect", [2], None),
        ("socket_send", [2], None),
        ("socket_write", [2], None),
        ("stream_socket_client", [1], None),
        ("stream_socket_server", [1], None),
        ("printer_open", [1], None),
    ],
    "SESSION_FIXATION": [
        ("setcookie", [2], None),
        ("setrawcookie", [2], None),
        ("session_id", [1], None),
    ],
    "REFLECTION": [
        ("event_buffer_new", [2, 3, 4], None),
        ("event_set", [4], None),
        ("iterator_apply", [2], None),
        ("forward_static_call", [1], None),
        ("forward_static_call_array", [1], None),
        ("call_user_func", [1], None),
        ("call_user_func_array", [1], None),
        ("array_diff_uassoc", [3], None),
        ("array_diff_ukey", [3], None),
        ("array_filter", [2], None),
        ("array_intersect_uassoc", [3], None),
        ("array_intersect_ukey", [3], None),
        ("array_map", [1], None),
        ("array_reduce", [2], None),
        ("array_udiff", [3], None),
        ("array_udiff_assoc", [3], None),
        ("array_udiff_uassoc", [3, 4], None),
        ("array_uintersect", [3], None),
        ("array_uintersect_assoc", [3], None),
        ("array_uintersect_uassoc", [3, 4], None),
        ("array_walk", [2], None),
        ("array_walk_recursive", [2], None),
        ("assert_options", [2], None),
        ("ob_start", [1], None),
        ("register_shutdown_function", [1], None),
        ("register_tick_function", [1], None),
        ("runkit_method_add", [1, 2, 3, 4], None),
        ("runkit_method_copy", [1, 2, 3], None),
        ("runkit_method_redefine", [1, 2, 3, 4], None),
        ("runkit_method_rename", [1, 2, 3], None),
        ("runkit_function_add", [1, 2, 3], None),
        ("runkit_function_copy", [1, 2], None),
        ("runkit_function_redefine", [1, 2, 3], None),
        ("runkit_function_rename", [1, 2], None),
        ("session_set_save_handler", [1, 2, 3, 4, 5], None),
        ("set_error_handler", [1], None),
        ("set_exception_handler", [1], None),
        ("spl_autoload", [1], None),
        ("spl_autoload_register", [1], None),
        ("sqlite_create_aggregate", [2, 3, 4], None),
        ("sqlite_create_function", [2, 3], None),
        ("stream_wrapper_register", [2], None),
        ("uasort", [2], None),
        ("uksort", [2], None),
        ("usort", [2], None),
        ("yaml_parse", [4], None),
        ("yaml_parse_file", [4], None),
        ("yaml_parse_url", [4], None),
        ("eio_busy", [3], None),
        ("eio_chmod", [4], None),
        ("eio_chown", [5], None),
        ("eio_close", [3], None),
        ("eio_custom", [1, 2], None),
        ("eio_dup2", [4], None),
        ("eio_fallocate", [6], None),
        ("eio_fchmod", [4], None),
        ("eio_fchown", [5], None),
        ("eio_fdatasync", [3], None),
        ("eio_fstat", [3], None),
        ("eio_fstatvfs", [3], None),
        ("preg_replace_callback", [2], None),
        ("dotnet_load", [1], None),
    ],
    "FILE_READ": [
        ("bzread", [1], "FILE"),
        ("bzflush", [1], "FILE"),
        ("dio_read", [1], "FILE"),
        ("eio_readdir", [1], "FILE"),
        ("fdf_open", [1], "FILE"),
        ("file", [1], "FILE"),
        ("file_get_contents", [1], "FILE"),
        ("finfo_file", [1, 2], None),
        ("fflush", [1], "FILE"),
        ("fgetc", [1], "FILE"),
        ("fgetcsv", [1], "FILE"),
        ("fgets", [1], "FILE"),
        ("fgetss", [1], "FILE"),
        ("fread", [1], "FILE"),
        ("fpassthru", [1, 2], None),
        ("fscanf", [1], "FILE"),
        ("ftok", [1], "FILE"),
        ("get_meta_tags", [1], "FILE"),
        ("glob", [1], None),
        ("gzfile", [1], "FILE"),
        ("gzgetc", [1], "FILE"),
        ("gzgets", [1], "FILE"),
        ("gzgetss", [1], "FILE"),
        ("gzread", [1], "FILE"),
        ("gzpassthru", [1], "FILE"),
        ("highlight_file", [1], "FILE"),
        ("imagecreatefrompng", [1], "FILE"),
        ("imagecreatefromjpg", [1], "FILE"),
        ("imagecreatefromgif", [1], "FILE"),
        ("imagecreatefromgd2", [1], "FILE"),
        ("imagecreatefromgd2part", [1], "FILE"),
        ("imagecreatefromgd", [1], "FILE"),
        ("opendir", [1], "FILE"),
        ("parse_ini_file", [1], "FILE"),
        ("php_strip_whitespace", [1], "FILE"),
        ("readfile", [1], "FILE"),
        ("readgzfile", [1], "FILE"),
        ("readlink", [1], "FILE"),
        ("stat", [1], None),
        ("scandir", [1], "FILE"),
        ("show_source", [1], "FILE"),
        ("simplexml_load_file", [1], "FILE"),
        ("stream_get_contents", [1], "FILE"),
        ("stream_get_line", [1], "FILE"),
        ("xdiff_file_bdiff", [1, 2], "FILE"),
        ("xdiff_file_bpatch", [1, 2], "FILE"),
        ("xdiff_file_diff_binary", [1, 2], "FILE"),
        ("xdiff_file_diff", [1, 2], "FILE"),
        ("xdiff_file_merge3", [1, 2, 3], "FILE"),
        ("xdiff_file_patch_binary", [1, 2], "FILE"),
        ("xdiff_file_patch", [1, 2], "FILE"),
        ("xdiff_file_rabdiff", [1, 2], "FILE"),
        ("yaml_parse_file", [1], "FILE"),
        ("zip_open", [1], "FILE"),
    ],
    "FILE_AFFECT": [
        ("bzwrite", [2], None),
        ("chmod", [1], "FILE"),
        ("chgrp", [1], "FILE"),
        ("chown", [1], "FILE"),
        ("copy", [1], None),
        ("dio_write", [1, 2], None),
        ("eio_chmod", [1], "FILE"),
        ("eio_chown", [1], "FILE"),
        ("eio_mkdir", [1], "FILE"),
        ("eio_mknod", [1], "FILE"),
        ("eio_rmdir", [1], "FILE"),
        ("eio_write", [1, 2], None),
        ("eio_unlink", [1], "FILE"),
        ("error_log", [3], "FILE"),
        ("event_buffer_write", [2], None),
        ("file_put_contents", [1, 2], "FILE"),
        ("fputcsv", [1, 2], "FILE"),
        ("fputs", [1, 2], "FILE"),
        ("fprintf", [0], None),
        ("ftruncate", [1], "FILE"),
        ("fwrite", [1, 2], "FILE"),
        ("gzwrite", [1, 2], None),
        ("gzputs", [1, 2], None),
        ("loadXML", [1], None),
        ("mkdir", [1], None),
        ("move_uploaded_file", [1, 2], "FILE"),
        ("posix_mknod", [1], "FILE"),
        ("recode_file", [2, 3], "FILE"),
        ("rename", [1, 2], "FILE"),
        ("rmdir", [1], "FILE"),
        ("shmop_write", [2], None),
        ("touch", [1], "FILE"),
        ("unlink", [1], "FILE"),
        ("vfprintf", [0], None),
        ("xdiff_file_bdiff", [3], "FILE"),
        ("xdiff_file_bpatch", [3], "FILE"),
        ("xdiff_file_diff_binary", [3], "FILE"),
        ("xdiff_file_diff", [3], "FILE"),
        ("xdiff_file_merge3", [4], "FILE"),
        ("xdiff_file_patch_binary", [3], "FILE"),
        ("xdiff_file_patch", [3], "FILE"),
        ("xdiff_file_rabdiff", [3], "FILE"),
        ("yaml_emit_file", [1, 2], "FILE"),
    ],
    "LDAP": [
        ("ldap_add", [2, 3], "LDAP"),
        ("ldap_delete", [2], "LDAP"),
        ("ldap_list", [3], "LDAP"),
        ("ldap_read", [3], "LDAP"),
        ("ldap_search", [3], "LDAP"),
    ],
    "XPATH": [
        ("xpath_eval", [2], "XPATH"),
        ("xpath_eval_expression", [2], "XPATH"),
        ("xptr_eval", [2], "XPATH"),
    ],
    "FILE_INCLUDE": [
        ("include", [1], "FILE"),
        ("include_once", [1], "FILE"),
        ("parsekit_compile_file", [1], "FILE"),
        ("php_check_syntax", [1], "FILE"),
        ("require", [1], "FILE"),
        ("require_once", [1], "FILE"),
        ("runkit_import", [1], "FILE"),
        ("set_include_path", [1], "FILE"),
        ("virtual", [1], "FILE"),
    ],
}
