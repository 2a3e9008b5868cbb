"""Detectors (label, pattern or JSON keys), log codes and parsers (label, pattern, field names), in order of priority.

Most syslog daemons differ by the program's name alone, so their patterns are made from it. Patterns match at the start
of a line. A detector's weight is 2 where the label counts twice in the first phase of the vote. JSON formats are told
by the keys of the line's object, the most specific first.
"""

from __future__ import annotations

from typing import NamedTuple

IP = r"(?:\d{1,3}\.){3}\d{1,3}"
SYS = r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
DAY = r"\d{4}-\d{2}-\d{2}"
CLOCK = r"\d{2}:\d{2}:\d{2}"
STAMP = rf"{DAY}\s+{CLOCK}"
VIEWER = rf"\d{{2}}-\d{{2}}-\d{{4}} {CLOCK}"
VERB = r"(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)"
LEVEL = r"(?:INFO|WARNING|ERROR|DEBUG)"
PROTOCOL = r"(?:tcp|udp|icmp)"


class Detector(NamedTuple):
    label: str
    pattern: str = ""
    weight: int = 1
    #: Keys of a JSON object; an empty string stands for a JSON array that is not empty.
    keys: tuple[str, ...] = ()


class Parser(NamedTuple):
    label: str
    pattern: str
    fields: tuple[str, ...]
    #: For JSON lines: the path of each field; for comma-separated ones the number of columns at least.
    paths: tuple[str, ...] = ()
    columns: int = 0


def daemon(program: str) -> str:
    """Lines `time host program[pid]: message` of a daemon."""
    return rf"{SYS}\s+\S+\s+{program}(?:\[\d+\])?:\s+"


def service(programs: str) -> str:
    """Lines `time program[pid]: message` of a network service, without a host."""
    return rf"\w{{3}}\s+\d{{1,2}}\s+{CLOCK}\s+(?:{programs})\[\d+\]:\S*\s+"


# Labels in order of priority, and what a line of each starts with
DETECTORS = (
    Detector("Apache", r'\S+ - - \[.*?\] ".*?" \d+ \S+'),
    Detector("Apache Error", r"\[.*?\] \[.*?:.*?\] \[pid \d+(?::tid \d+)?\] "),
    Detector("NGINX", r'\S+ - \S+ \[.*?\] ".*?" \d+ \d+'),
    Detector("Django", r'\[.*?\] "\w+ /\S+" \d+'),
    Detector("Flask", rf'\[[\d/\-]+ [\d:]+\] "\w+ \S+ \S+" \d+|\* (?:Running on|Restarting)|http://{IP}|{VERB}\s+/\S+\s+\d{{3}}$'),
    Detector("Node.js", r"\w+ /\S+ \d+ \d+ms"),
    Detector("AWS CloudTrail", keys=("eventTime", "eventName", "awsRegion")),
    Detector("AWS GuardDuty", keys=("schemaVersion", "accountId", "type", "severity")),
    Detector("Azure Activity", keys=("time", "operationName", "resource", "status")),
    Detector("GCP Audit", keys=("protoPayload", "methodName", "resourceName")),
    Detector("Kubernetes", keys=("log", "stream", "docker")),
    Detector("Docker", keys=("log", "stream", "time")),
    Detector("Cloudflare", keys=("timestamp", "Edge", "Request")),
    Detector("MongoDB Audit", keys=("atype", "ts")),
    Detector("MongoDB Server", keys=("t", "s", "c", "msg"), weight=2),
    Detector("Elasticsearch", keys=("type", "timestamp", "level", "message")),
    Detector("Express.js", r"\{"),
    Detector("Laravel", rf"\[{DAY} .*?\] \w+\.\w+:"),
    Detector("Ruby on Rails", r".*(?:Processing by|Started GET)"),
    Detector("Gunicorn", rf"\[{DAY} {CLOCK}.*\] \[\d+\] \[(?:INFO|ERROR|WARNING)\]"),
    Detector("Uvicorn", r'INFO:\s+.* - "\w+ .* HTTP/\d\.\d" \d{3}'),
    Detector("PHP-FPM", r".*\[pool |\] (?:NOTICE|WARNING|ERROR):"),
    Detector("FastAPI", rf'{DAY}[T\s]{CLOCK}\.\d+.*?{LEVEL}.*?"(?:GET|POST|PUT|DELETE|PATCH)\s+\S+\s+HTTP/\d\.\d"\s+\d{{3}}'),
    Detector("aiohttp", rf'{STAMP}\.\d+\s+{LEVEL}.*"(?:GET|POST|PUT|DELETE)\s+\S+\s+\d{{3}}"'),
    Detector("Starlette", rf'{STAMP}\.\d+\s+{LEVEL}.*"(?:GET|POST|PUT|DELETE|PATCH)\s+\S+\s+\d{{3}}"'),
    Detector("Caddy", rf"{IP}\s+-\s+-\s+\[INFO\]\s+http\.log:\s+handled\s+(?:GET|POST|PUT|DELETE)\s+\S+\s+\d{{3}}$"),
    Detector("HAProxy", rf"{SYS}\s+haproxy\[\d+\]:\s+(?:GET|POST|PUT|DELETE)\s+\S+\s+\d{{3}}$"),
    Detector("Spring Boot", rf"{STAMP}\.\d+\s+(?:INFO|WARN|ERROR|DEBUG)\s+\S+\s+-\s+(?:GET|POST|PUT|DELETE|PATCH)\s+\S+\s+\d{{3}}$"),
    Detector("ASP.NET Core", r"(?:info|warn|error|debug):\s+Microsoft\.AspNetCore"),
    Detector("IIS", rf"{STAMP}\s+{IP}\s+(?:GET|POST|PUT|DELETE)\s+/\S*\s+.*\s+\d{{3}}\s*"),
    Detector("Postfix", r".*(?:postfix/|amavis\[|opendkim\[|roundcube:)"),
    Detector("Sendmail", daemon(r"sendmail(?=\[)")),
    Detector("Exim", rf"{STAMP}\s+[A-Za-z0-9-]{{6,}}\s+(?:<=|=>|\*\*)\s+\S+"),
    Detector("Dovecot", rf"{SYS}\s+\S+\s+dovecot:\s+(?:imap|pop3)-login:\s+."),
    Detector("Courier", rf"{STAMP}\s+\S+\s+courier(?:imap|pop3):\s+(?:LOGIN|LOGOUT),\s+user="),
    Detector("Microsoft Exchange", rf"{DAY}T{CLOCK}\.\d+Z,SMTP(?:Receive|Send|Deliver),."),
    Detector("SMTP Server", rf"{STAMP}\s+SMTP\s+(?:connect|disconnect|from=|to=)."),
    Detector("Amavis", daemon(r"amavis(?=\[)")),
    Detector("SpamAssassin", daemon(r"spamd(?=\[)")),
    Detector("MailScanner", daemon(r"MailScanner(?=\[)")),
    Detector("Windows Firewall", rf"{STAMP}\s+(?:ALLOW|DROP|BLOCK)\s+(?:TCP|UDP|ICMP)\s+{IP}\s+{IP}\s+\d+\s+\d+"),
    Detector("Windows Event Viewer", rf"(?:Audit (?:Success|Failure|Error|Warning)|Success|Failure|Error|Warning)(?: {VIEWER} |\t{VIEWER}\t)"),
    Detector("Windows Application TXT", rf"(?:Information|Warning|Error|Critical)\t{VIEWER}\t|Level\tDate and Time\tSource\tEvent ID\tTask Category"),
    Detector("Windows Security CSV", r"TimeCreated,EventID,LevelDisplayName,LogName,MachineName,Message,AccountName,LogonType,IpAddress|(?!.*TimeCreated)(?:[^,]*,){3}Security,(?:[^,]*,){4}"),
    Detector("Windows Application CSV", rf"(?:Information|Warning|Error|Critical|Audit (?:Success|Failure|Error|Warning)),{VIEWER},[^,]+,\d+,[^,]+,|{STAMP},\d+,[^,]+,[^,]+,[^,]+,|(?:Level|Keywords|TimeCreated),"),
    Detector("Windows Event", rf"{STAMP}\s*,?\s*{LEVEL}\s*,?\s*\S+\s*,?\s*\d+"),
    Detector("Windows Security", rf"{STAMP}\s+(?:INFO|WARNING|ERROR)\s+Security\s+\d+\s+"),
    Detector("Windows Application", rf"{STAMP}\s+(?:INFO|WARNING|ERROR)\s+Application\s+\d+\s+"),
    Detector("Windows System", rf"{STAMP}\s+(?:INFO|WARNING|ERROR)\s+System\s+\d+\s+"),
    Detector("Windows Setup", rf"{STAMP}\s+Setup\s+\d+\s+(?:INFO|WARNING|ERROR|CRITICAL)"),
    Detector("Windows Forwarded Events", rf"{STAMP}\s+ForwardedEvents\s+\d+\s+(?:INFO|WARNING|ERROR|CRITICAL)"),
    Detector("Windows Text", rf"{DAY}[\sT]{CLOCK},\s*[^,]+,\s*[^,]+,\s*\d+,", weight=2),
    Detector("iptables", rf"(?i){SYS}\s+\S+\s+kernel:\s*(?:\[[\d.]+\])?\s*IPTABLES-(?:DROP|ACCEPT):\s+IN=\S*\s+OUT=\S*\s+.*SRC={IP}\s+DST={IP}.*PROTO={PROTOCOL}"),
    Detector("UFW", rf"(?i){SYS}\s+\S+\s+kernel:\s*\[\d+\.\d+\]\s*\[UFW (?:ALLOW|BLOCK)\]\s+IN=\S*\s+OUT=\S*\s+SRC={IP}\s+DST={IP}"),
    Detector("nftables", rf"{SYS}\s+\S+\s+kernel:\s+nftables:\s+rule\s+(?:accept|drop|reject)\s+.*{PROTOCOL}"),
    Detector("firewalld", rf"{SYS}\s+\S+\s+firewalld:\s+(?:INFO|WARNING|ERROR):\s+"),
    Detector("macOS PF", rf"{CLOCK}\.\d+\s+rule\s+\d+/\d+\s*\(match\):\s+(?:block|pass)\s+(?:in|out)\s+on\s+\S+:\s+{IP}\.\d+\s+>\s+{IP}\.\d+"),
    Detector("macOS App Firewall", rf"Firewall:\s+(?:Blocked|Allowed)\s+(?:incoming|outgoing)\s+connection from\s+{IP}\s+to\s+app\s+\S+"),
    Detector("Palo Alto Firewall", rf"\d{{4}}/\d{{2}}/\d{{2}}\s+{CLOCK}\s+(?:allow|deny|drop)\s+{PROTOCOL}\s+{IP}\s+{IP}\s+rule=\S+"),
    Detector("FortiGate", rf"date={DAY}\s+time={CLOCK}\s+action=(?:allow|deny)\s+srcip={IP}\s+dstip={IP}"),
    Detector("Cisco ASA", rf"{SYS}\s+\S+\s+%ASA-\d-\d+:\s+access-list\s+\S+\s+(?:denied|permitted)\s+{PROTOCOL}\s+\S+/{IP}\s+to\s+\S+/{IP}"),
    Detector("Check Point Firewall", rf"{STAMP}\s+(?:accept|drop|reject)\s+(?:TCP|UDP|ICMP)\s+src={IP}\s+dst={IP}\s+rule=\S+"),
    Detector("AWS VPC Flow Logs", rf"\d+\s+\d+\s+eni-\S+\s+{IP}\s+{IP}(?:\s+\d+){{6}}\s+(?:ACCEPT|REJECT)\s+\S+$"),
    Detector("Azure NSG Flow Logs", rf'\{{(?=.*"time"\s*:\s*"{DAY}T{CLOCK}(?:\.\d+)?Z")(?=.*"properties"\s*:\s*\{{)(?=.*"flows"\s*:\s*\[)(?=.*"flowTuples"\s*:\s*\[).*\}}$'),
    Detector("GCP VPC Firewall", rf"{DAY}T{CLOCK}Z\s+(?:allow|deny)\s+{PROTOCOL}\s+{IP}:\d+\s+{IP}:\d+"),
    Detector("Disk Traffic", r'.*type="traffic"'),
    Detector("Moodle LMS", r'\[\["19(?:\\?/)?\d{2}(?:\\?/)?\d{2},\s+\d{2}:\d{2}"'),
    Detector("Application Logs JSON", keys=("",)),
    Detector("MySQL Error", rf"{DAY}T[\d:.]+Z?\s+\d+\s+\[(?:ERROR|Warning|Note)\]\s+\[MY-\d+\]\s+\[\w+\]\s+"),
    Detector("MySQL Query", rf"{DAY}T[\d:.]+Z?\s+\d+\s+(?:Query|Connect|Execute)\s+"),
    Detector("MySQL Slow Query", r"# Time:"),
    Detector("PostgreSQL Error", rf"{DAY}\s+[\d:.]+\s+UTC\s+\[\d+\]\s+\S+\s+(?:LOG|ERROR|FATAL|PANIC):"),
    Detector("PostgreSQL Auth", rf"{DAY}\s+[\d:.]+\s+UTC\s+\[\d+\]\s+\S+\s+LOG:\s+connection received:.*host={IP}\s+port=\d+"),
    Detector("PostgreSQL Statement", rf"{DAY}\s+[\d:.]+\s+[A-Za-z]{{3,4}}(?:/[A-Za-z]+)?\s+\[\d+\]\s+STATEMENT:\s+.*;"),
    Detector("Oracle Alert", rf"[A-Za-z]{{3}}\s+[A-Za-z]{{3}}\s+\d{{2}}\s+{CLOCK}\s+\d{{4}}"),
    Detector("Oracle Listener", rf".*?\s+\*.*SERVICE_NAME=\w+.*PROTOCOL=\w+.*HOST={IP}.*PORT=\d+.*\*\s+\d+"),
    Detector("Oracle Audit", r"Audit trail:"),
    Detector("SQL Server Error", r".*? Server Error: \d+, Severity: \d+, State: \d+"),
    Detector("SQL Server Audit", r"(?i)action_id=\w+.*(?:name=\S+|database_name=\S+|statement=)"),
    Detector("SQL Server Transaction", r"\(\d+:\d+:\d+\).*Operation:\s+"),
    Detector("Linux SSHD Failed", daemon(r"sshd(?=\[)") + rf"Failed\s+\w+\s+for\s+(?:invalid\s+user\s+)?\S+\s+from\s+{IP}\s+port\s+\d+"),
    Detector("Linux SSHD Accepted", daemon(r"sshd(?=\[)") + rf"Accepted\s+\w+\s+for\s+\S+\s+from\s+{IP}\s+port\s+\d+"),
    Detector("Linux Syslog", rf"\w{{3}}\s+\d+\s+{CLOCK}\s+\S+\s+[\w\-/]+\[\d+\]:\s+"),
    Detector("Linux Systemd", rf"\w{{3}}\s+\d+\s+{CLOCK}\s+\S+\s+systemd\[\d+\]:\s+"),
    Detector("Linux Kernel", rf"\w{{3}}\s+\d+\s+{CLOCK}\s+\S+\s+kernel:\s+"),
    Detector("Linux Audit", r"type=\w+\s+msg=audit\(\d+\.\d+:\d+\):"),
    Detector("Linux Package", rf"{DAY}\s+{CLOCK}\s+(?:status|configure|install|trigproc|upgrade)\s+"),
    Detector("FileZilla FTP", rf"\(\d+\)\d{{2}}/\d{{2}}/\d{{4}} {CLOCK} - \S+ \([\d.]+\)> \d+ "),
    Detector("IIS FTP", rf"{STAMP}\s+[\d.]+\s+[\w\-]+\s+[\d.]+\s+\d+\s+\w+\s+\S*\s+\d+"),
    Detector("xferlog", rf"\w{{3}}\s+\w{{3}}\s+\d{{1,2}}\s+{CLOCK}\s+\d{{4}}\s+\d+\s+[\d.]+\s+\d+\s+\S+\s+[ab]\s+_\s+[io]\s+[ra]\s+\S+\s+\w+\s+[01]\s+\*\s+[ci]"),
    Detector("VSFTPD", rf"\w{{3}}\s+\d{{1,2}}\s+{CLOCK}\s+\S+\s+vsftpd\[\d+\]:\s+\[[^\]]+\]\s+(?:OK|FAIL)\s+\w+:\s+"),
    Detector("ProFTPD", rf"\w{{3}}\s+\d+\s+{CLOCK}\s+\S+\s+(?:proftpd|pure-ftpd)\[\d+\]:\s+"),
    Detector("DHCP", service("dhcpd?|dhclient")),
    Detector("DNS", service("named|bind|dnsmasq|unbound")),
    Detector("Proxy", service("squid|haproxy|nginx|microsocks")),
    Detector("Redis", rf"\d+:[\sM]\s+\d+\s+\w+\s+\d+\s+(?:\w+\s+)?{CLOCK}\.\d+\s+\S+\s+"),
    Detector("RabbitMQ", rf"{STAMP}\.\d+\s+\[info\]\s+<\d+\.\d+>"),
    Detector("Kafka", rf"\[{DAY}T{CLOCK},\d+\s+\w+\]\s+"),
    Detector("Zookeeper", rf"{STAMP}\.\d+\s+\[myid:\d+\]\s+-\s+\w+\s+\[.*\]\s+"),
    Detector("Nginx Error", rf"\d{{4}}/\d{{2}}/\d{{2}}\s+{CLOCK}\s+\[\w+\]\s+\d+#\d+:\s+"),
    Detector("Squid", rf"\d+\.\d+\s+\d+\s+{IP}\s+\S+/\d+\s+\d+\s+\S+\s+\S+\s+\S+\s+\S+"),
    Detector("Suricata", r"\[\d+:\d+:\d+\]\s+\S+\s+\S+\s+\[Classification:.*\]\[Priority:\d+\]\s+\{.*\}"),
    Detector("Zeek", rf"\d+\.\d+\s+\S+\s+{IP}\s+\d+\s+{IP}\s+\d+\s+\S+\s+"),
    Detector("Ossec", r"\*\*Alert \d+\.\d+\s+-\s+\S+\s+\S+\s+-\s+Rule:\s+\d+\s+-\s+Level:\s+\d+\s+-\s+"),
    Detector("Fail2ban", rf"{STAMP},\d+\s+\w+\s+\[\d+\]:\s+\w+\s+\[\S+\]\s+"),
    Detector("Auth0", rf"\d{{2}}/\w+/\d{{4}}:{CLOCK}\s+\S+\s+\[\d+\]\s+\[\w+\]:"),
    Detector("Apache Combined", r'\S+\s+-\s+-\s+\[.*?\]\s+".*?"\s+\d+\s+\d+\s+".*?"\s+".*?"'),
)

#: Predicates that no vote uses.
EXTRA_DETECTORS = (
    Detector("Linux SSHD PAM", rf"\w{{3}}\s+\d{{1,2}}\s+{CLOCK}\s+\S+\s+sshd\(pam_unix\)\[\d+\]:\s+(?:authentication failure|check pass|session (?:opened|closed))"),
    Detector("JSON FTP Logs", r"\[\[.*\]\]$"),
    Detector("FastAPI JSON", r'\{"time":\s*".*?",\s*"framework":\s*"FastAPI"'),
)

# Label of a detector to the code of its log type; raw if none
LOG_CODES = {
    "Apache": "apache", "Apache Error": "apache", "NGINX": "nginx", "Nginx Error": "nginx", "Django": "django", "Flask": "flask", "Node.js": "express", "Express.js": "express",
    "Laravel": "laravel", "Ruby on Rails": "rails", "Gunicorn": "gunicorn", "Uvicorn": "uvicorn", "FastAPI": "fastapi", "IIS": "iis",
    "Postfix": "postfix", "Sendmail": "sendmail", "Exim": "exim", "Dovecot": "dovecot",
    "iptables": "iptables", "UFW": "ufw", "nftables": "nftables", "firewalld": "firewalld", "Palo Alto Firewall": "palo_alto", "FortiGate": "fortigate", "Cisco ASA": "cisco_asa",
    "Check Point Firewall": "checkpoint", "AWS VPC Flow Logs": "aws_vpc_flow", "Azure NSG Flow Logs": "azure_nsg", "GCP VPC Firewall": "gcp_vpc",
    "MySQL Error": "mysql_error", "MySQL Query": "mysql_query", "MySQL Slow Query": "mysql_slow",
    "PostgreSQL Error": "postgres_error", "PostgreSQL Auth": "postgres_auth", "PostgreSQL Statement": "postgres_statement",
    "Oracle Alert": "oracle_alert", "Oracle Listener": "oracle_listener", "Oracle Audit": "oracle_audit",
    "SQL Server Error": "sqlserver_error", "SQL Server Audit": "sqlserver_audit", "SQL Server Transaction": "sqlserver_transaction",
    "MongoDB Server": "mongodb_server", "MongoDB Audit": "mongodb_audit",
    "Linux SSHD Failed": "ssh_auth", "Linux SSHD Accepted": "ssh_auth", "Linux Syslog": "syslog", "Linux Systemd": "systemd", "Linux Kernel": "kernel", "Linux Audit": "audit",
    "Windows Event": "windows_event", "Windows Security": "windows_security", "Windows Application": "windows_application", "Windows System": "windows_system",
    "VSFTPD": "vsftpd", "ProFTPD": "proftpd", "FileZilla FTP": "vsftpd", "IIS FTP": "iis_ftp", "xferlog": "vsftpd", "DHCP": "dhcp", "DNS": "dns", "Proxy": "proxy",
    "Cloudflare": "cloudflare", "AWS CloudTrail": "cloudtrail", "AWS GuardDuty": "aws_guardduty", "Azure Activity": "azure_activity", "GCP Audit": "gcp_audit",
    "Kubernetes": "kubernetes", "Docker": "docker", "Elasticsearch": "elasticsearch", "Redis": "redis", "RabbitMQ": "rabbitmq", "Kafka": "kafka", "Zookeeper": "zookeeper",
    "Squid": "squid", "Suricata": "suricata", "Zeek": "zeek", "Ossec": "ossec", "Fail2ban": "fail2ban", "Auth0": "auth0",
}


PARSERS = (
    Parser("Apache", r'(\S+) - (?:\S+) \[([^\]]*)\] "([^"]*)" (\d+) (\S+)', ("ip", "timestamp", "request", "status", "bytes")),
    Parser("NGINX", r'(\S+) - (\S+) \[([^\]]*)\] "([^"]*)" (\d+) (\d+)', ("ip", "user", "timestamp", "request", "status", "bytes")),
    Parser("Linux SSHD Failed", rf"({SYS})\s+(\S+)\s+sshd\[(\d+)\]:\s+Failed (\w+) for (?:invalid user )?(\S+) from (\S+) port (\d+)", ("timestamp", "host", "pid", "method", "user", "ip", "port")),
    Parser("Linux SSHD Accepted", rf"({SYS})\s+(\S+)\s+sshd\[(\d+)\]:\s+Accepted (\w+) for (\S+) from (\S+) port (\d+)", ("timestamp", "host", "pid", "method", "user", "ip", "port")),
    Parser("Postfix", rf"({SYS})\s+(\S+)\s+(postfix/\w+)\[(\d+)\]:\s+(.*)", ("timestamp", "host", "service", "pid", "message")),
    Parser("Sendmail", rf"({SYS})\s+(\S+)\s+(sendmail)\[(\d+)\]:\s+(.*)", ("timestamp", "host", "service", "pid", "message")),
    Parser("Exim", rf"({DAY} {CLOCK}) (\S+) (<=|=>|\*\*) (\S+)(.*)", ("timestamp", "message_id", "direction", "recipient", "message")),
    Parser("Dovecot", rf"({SYS})\s+(\S+)\s+dovecot:\s+(\w+)-login:\s+([^:]+):\s+user=<([^>]*)>.*?rip=({IP})(?:, lip=({IP}))?(.*)", ("timestamp", "hostname", "protocol", "login_type", "user", "remote_ip", "local_ip", "details")),
    Parser("iptables", rf"({SYS})\s+(\S+)\s+kernel:.*IPTABLES-(\w+):\s+IN=(\S*)\s+OUT=(\S*).*SRC=({IP}).*DST=({IP}).*PROTO=(\w+)(?:.*SPT=(\d+))?(?:.*DPT=(\d+))?", ("timestamp", "hostname", "action", "in_iface", "out_iface", "src_ip", "dst_ip", "protocol", "src_port", "dst_port")),
    Parser("UFW", rf"({SYS})\s+(\S+)\s+(?:kernel|ufw\[\d+\]):.*\[UFW (\w+)\]\s+IN=(\S*)\s+OUT=(\S*).*SRC=({IP}).*DST=({IP})", ("timestamp", "hostname", "action", "in_iface", "out_iface", "src_ip", "dst_ip")),
    Parser("Windows Firewall", rf"({DAY} {CLOCK}) (\w+) (\w+) ({IP}) ({IP}) (\d+) (\d+)", ("timestamp", "action", "protocol", "src_ip", "dst_ip", "src_port", "dst_port")),
    Parser("MySQL Error", rf"({DAY}T\S+)\s+(\d+) \[(\w+)\] \[MY-(\d+)\] \[(\w+)\] (.*)", ("timestamp", "thread_id", "error_level", "error_code", "component", "error_message")),
    Parser("MySQL Query", rf"({DAY}T\S+)\s+(\d+) (\w+)\s+(.*)", ("timestamp", "thread_id", "query_type", "sql_statement")),
    Parser("MySQL Slow Query", r"(?s)# Time: (\S+).*?# User@Host: (\w*)\[(\w*)\] @ (\S*) \[([\d.]*)\].*?# Query_time: ([\d.]+)\s+Lock_time: ([\d.]+)\s+Rows_sent: (\d+)\s+Rows_examined: (\d+)\s+(.*)", ("timestamp", "user", "db_user", "host", "ip", "query_time", "lock_time", "rows_sent", "rows_examined", "sql_statement")),
    Parser("PostgreSQL Error", rf"({DAY} [\d:.]+) UTC \[(\d+)\] (\w+)@(\w+) (\w+):\s+(.*)", ("timestamp", "pid", "username", "database", "level", "message")),
    Parser("PostgreSQL Auth", rf"({DAY} [\d:.]+) UTC \[(\d+)\] (\S+) LOG:\s+connection received: host=({IP}) port=(\d+)", ("timestamp", "pid", "process", "ip", "port")),
    Parser("PostgreSQL Statement", rf"({DAY} [\d:.]+) ([A-Z]{{3,4}}) \[(\d+)\] (STATEMENT):\s+(.*?);?$", ("timestamp", "timezone", "pid", "log_type", "statement")),
    Parser("Linux Systemd", rf"({SYS})\s+(\S+)\s+systemd\[(\d+)\]:\s+(.*)", ("timestamp", "host", "pid", "message")),
    Parser("IIS FTP", rf"({DAY}) ({CLOCK}) ({IP}) (\S+) ({IP}) (\d+) (\w+) (\S+) (\d+) (\d+) (\d+)", ("date", "time", "client_ip", "username", "server_ip", "server_port", "method", "uri_stem", "status", "sc_bytes", "cs_bytes")),
    Parser("IIS", rf"({DAY}) ({CLOCK}) ({IP}) ({VERB}) (\S+) (\S+).* (\d{{3}}) \d+ \d+ (\d+)", ("date", "time", "server_ip", "method", "path", "query", "status", "bytes")),
    Parser("Windows Event", rf"({DAY} {CLOCK})\s*,?\s*(\w+)\s*,?\s*([^\s,]+)\s*,?\s*(\d+)\s*,?\s*(.*)", ("timestamp", "level", "source", "event_id", "message")),
    Parser("Palo Alto Firewall", rf"(\d{{4}}/\d{{2}}/\d{{2}} {CLOCK}) (\w+) (\w+) ({IP}) ({IP}) rule=(\S+)", ("timestamp", "action", "protocol", "src_ip", "dst_ip", "rule")),
    Parser("FortiGate", rf"date=({DAY}) time=({CLOCK}) action=(\w+)(?: srcip=({IP}))?(?: dstip=({IP}))?", ("date", "time", "action", "src_ip", "dst_ip")),
    Parser("Cisco ASA", rf"({SYS})\s+(\S+)\s+%ASA-\d-\d+:\s+access-list \S+ (\w+) (\w+)", ("timestamp", "hostname", "action", "protocol")),
    Parser("VSFTPD", rf'({SYS})\s+(\S+)\s+vsftpd\[(\d+)\]:\s+\[([^\]]+)\] (OK|FAIL) (\w+): Client "([^"]*)"(?:, "([^"]*)")?', ("timestamp", "hostname", "pid", "username", "status", "action", "client_ip", "filename")),
    Parser("FileZilla FTP", rf"\((\d+)\)\s*(\S+) ({CLOCK}) - (\S+) \(([\d.]+)\)> (\d+) (.*)", ("connection_id", "date", "time", "username", "ip", "status_code", "message")),
    Parser("xferlog", rf"(\w{{3}}) (\w{{3}}) +(\d+) ({CLOCK}) (\d{{4}}) (\d+) (\S+) (\d+) (\S+) (\w) (\S) (\w) (\w) (\S+) (\w+) (\d) (\S) (\w)", ("weekday", "month", "day", "time", "year", "seconds", "remote_host", "bytes_sent", "filename", "transfer_type", "special_action", "direction", "access_mode", "username", "service_name", "authentication_method", "user_id", "completed")),
    Parser("Node.js", rf"({VERB}) (\S+) (\d+) (\d+) ?ms", ("method", "path", "status", "latency_ms")),
    Parser("Flask", rf"({VERB})\s+(\S+)\s+(\d{{3}})$", ("method", "path", "status")),
    Parser("Oracle Listener", rf"(\S+ {CLOCK}) \* .*?SERVICE_NAME=(\w+).*?PROTOCOL=(\w+).*?HOST=([^)]+).*?PORT=(\d+).*? \* (\w+) \* (\w+) \* (\d+)", ("timestamp", "service_name", "protocol", "host", "port", "action", "service", "result")),
    Parser("SQL Server Error", r"(\S+ \S+).*Server Error: (\d+), Severity: (\d+), State: (\d+)\.?\s*(.*)", ("timestamp", "error_number", "severity", "state", "message")),
    Parser("Squid", rf"(\d+\.\d+)\s+(\d+) ({IP}) (\w+)/(\d+) (\d+) (\w+) (\S+)", ("timestamp", "duration", "ip", "code", "status", "bytes", "method", "url")),
    Parser("Redis", r"(\d+):[A-Z] (\d+ \w+ \d{4} [\d:.]+) (\S) (.*)", ("pid", "timestamp", "level", "message")),
    Parser("Linux Syslog", rf"({SYS})\s+(\S+)\s+([\w./-]+)\[(\d+)\]:\s+(.*)", ("timestamp", "host", "process", "pid", "message")),
    Parser("Django", rf'\[([^\]]+)\] (\w+)\s+\[([^\]]+)\]\s+"(\w+)\s+(\S+)"\s+(\d+)', ("timestamp", "level", "module", "method", "path", "status")),
    Parser("Django Query", r"\[([^\]]+)\]\s+(\w+)\s+\[([^\]]+)\]\s+\(([\d.]+)\)\s+(.+)", ("timestamp", "level", "module", "duration_sec", "query")),
    Parser("Django Message", r"\[([^\]]+)\]\s+(\w+)\s+\[([^\]]+)\]\s+(.+)", ("timestamp", "level", "module", "message")),
    Parser("Django Access", rf'\[([^\]]*)\] "({VERB}) (\S+?)"?(?: HTTP/[\d.]+")? (\d{{3}})', ("timestamp", "method", "path", "status")),
    Parser("OpenDKIM", rf"({SYS})\s+(\S+)\s+(opendkim)\[(\d+)\]:\s+(.+)", ("timestamp", "host", "service", "pid", "message")),
    Parser("Roundcube", rf"({SYS})\s+(\S+)\s+(roundcube):\s+(.+)", ("timestamp", "host", "service", "message")),
    Parser("Windows Security", rf"({STAMP})\s+(INFO|WARNING|ERROR)\s+Security\s+(\d+)\s+(?:User:\s*(\S+))?\s*(.*)", ("timestamp", "level", "event_id", "user", "message")),
    Parser("SQL Server Audit", r"(?:.*?\bevent_time=([^=]+?)(?=\s+\w+=|$))?(?=.*\w+=)(?:.*?\bdatabase_name=(\S+))?(?:.*?\bserver_principal_name=(\S+))?(?:.*?\bstatement=(.+))?", ("timestamp", "database", "user", "statement")),
    Parser("SQL Server Transaction", r"\((\d+):(\d+):(\d+)\)\s+(.*)", ("spid", "slot", "sequence", "description")),
    Parser("JSON FTP Logs", "", ("timestamp", "user", "ip", "action", "file"), paths=("$[0][0].timestamp", "$[0][0].user", "$[0][0].ip", "$[0][0].action", "$[0][0].file")),
    Parser("Windows Security CSV", STAMP, ("timestamp", "event_id", "level", "log_name", "machine_name", "message", "account_name", "logon_type", "ip_address"), columns=8),
    Parser("Windows Application CSV", STAMP, ("timestamp", "event_id", "level", "log_name", "machine_name", "provider_name", "message"), columns=6),
    Parser(
        "MongoDB Server", "", ("timestamp", "severity", "component", "message", "remote", "connection_id", "user", "database", "command", "duration_ms", "plan_summary", "roles"),
        paths=("$.t['$date']", "$.s", "$.c", "$.msg", "$.attr.remote", "$.attr.connectionId", "$.attr.user", "$.attr.db", "$.attr.command", "$.attr.duration", "$.attr.planSummary", "$.attr.roles"),
    ),
    Parser(
        "MongoDB Audit", "", ("timestamp", "atype", "action", "user", "database", "collection", "ip", "port"),
        paths=("$.ts['$date']", "$.atype", "$.action", "$.param.user", "$.param.db", "$.param.collection", "$.param.ip", "$.param.port"),
    ),
    Parser(
        "AWS CloudTrail", "", ("timestamp", "event_name", "event_source", "user_identity", "source_ip", "user_agent", "request_params", "response_elements"),
        paths=("$.eventTime", "$.eventName", "$.eventSource", "$.userIdentity.arn", "$.sourceIPAddress", "$.userAgent", "$.requestParameters", "$.responseElements"),
    ),
    Parser("Kubernetes", "", ("timestamp", "stream", "message", "container", "pod", "namespace"), paths=("$.time", "$.stream", "$.log", "$.container.name", "$.pod.name", "$.pod.namespace")),
    Parser("Docker", "", ("timestamp", "stream", "message"), paths=("$.time", "$.stream", "$.log")),
    Parser(
        "Suricata", "", ("timestamp", "event_type", "src_ip", "dest_ip", "src_port", "dest_port", "proto", "alert", "signature"),
        paths=("$.timestamp", "$.event_type", "$.src_ip", "$.dest_ip", "$.src_port", "$.dest_port", "$.proto", "$.alert", "$.alert.signature"),
    ),
    Parser("Elasticsearch", "", ("timestamp", "level", "logger", "message", "host"), paths=("$['@timestamp']", "$['log.level']", "$['log.logger']", "$.message", "$.host.name")),
)

# Labels and the parsers that read their lines, the first that fits; a label that holds one of these names
# in any case takes its parsers too, the first of the table
DISPATCH = {
    "Apache": ("Apache",), "NGINX": ("NGINX",), "Django": ("Django", "Django Query", "Django Message", "Django Access"), "Flask": ("Django", "Django Query", "Django Message", "Flask"),
    "Node.js": ("Django", "Django Query", "Django Message", "Node.js"), "Express.js": ("Django", "Django Query", "Django Message"), "FastAPI": ("Django", "Django Query", "Django Message"),
    "Gunicorn": ("Django", "Django Query", "Django Message"), "Linux SSHD Failed": ("Linux SSHD Failed",), "Linux SSHD Accepted": ("Linux SSHD Accepted",),
    "Postfix": ("Postfix", "OpenDKIM", "Roundcube"), "OpenDKIM": ("OpenDKIM",), "Roundcube": ("Roundcube",), "Sendmail": ("Sendmail",), "Exim": ("Exim",), "Dovecot": ("Dovecot",),
    "iptables": ("iptables",), "UFW": ("UFW",), "nftables": ("iptables",), "firewalld": ("iptables",), "Palo Alto Firewall": ("Palo Alto Firewall",), "FortiGate": ("FortiGate",),
    "Cisco ASA": ("Cisco ASA",), "VSFTPD": ("VSFTPD",), "ProFTPD": ("VSFTPD",), "FileZilla FTP": ("FileZilla FTP",), "IIS FTP": ("IIS FTP",), "xferlog": ("xferlog",),
    "MySQL Error": ("MySQL Error",), "MySQL Query": ("MySQL Query",), "MySQL Slow Query": ("MySQL Slow Query",), "PostgreSQL Error": ("PostgreSQL Error",), "PostgreSQL Auth": ("PostgreSQL Auth",),
    "PostgreSQL Statement": ("PostgreSQL Statement",), "Oracle Alert": ("PostgreSQL Error",), "Oracle Listener": ("Oracle Listener",), "SQL Server Error": ("SQL Server Error",),
    "SQL Server Audit": ("SQL Server Audit",), "SQL Server Transaction": ("SQL Server Transaction",), "MongoDB Server": ("MongoDB Server",), "MongoDB Audit": ("MongoDB Audit",),
    "Linux Syslog": ("Linux Syslog",), "Linux Systemd": ("Linux Systemd",), "Linux Kernel": ("Linux Syslog",), "Linux Audit": ("Linux Syslog",), "IIS": ("IIS",), "Windows Event": ("Windows Event",),
    "Windows Security CSV": ("Windows Security CSV",), "Windows Application CSV": ("Windows Application CSV",), "JSON FTP Logs": ("JSON FTP Logs",), "AWS CloudTrail": ("AWS CloudTrail",),
    "AWS GuardDuty": ("AWS CloudTrail",), "Azure Activity": ("AWS CloudTrail",), "GCP Audit": ("AWS CloudTrail",), "Kubernetes": ("Kubernetes",), "Docker": ("Docker",), "Squid": ("Squid",),
    "Suricata": ("Suricata",), "Redis": ("Redis",), "Elasticsearch": ("Elasticsearch",), "Windows Firewall": ("Windows Firewall",), "Windows Security": ("Windows Security",),
}
