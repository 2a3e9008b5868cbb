"""Tables of the attack labels: patterns by log category, ordered classes, tactics and techniques."""

from __future__ import annotations

# Category of a detected log type, the first pattern that its lower-case name holds; generic if none
LOG_CATEGORIES = (
    ("webserver", r"apache|nginx|iis|express|django|flask|fastapi|laravel|rails|gunicorn|uvicorn|node|caddy|haproxy|spring|asp\.net"),
    ("authentication", r"ssh|auth|login|sshd|windows.*security"),
    ("firewall", r"firewall|iptables|ufw|nftables|palo|fortigate|cisco|checkpoint|aws.*vpc|azure.*nsg|gcp.*vpc"),
    ("database", r"mysql|postgres|oracle|sql.*server|mongodb"),
    ("mail", r"postfix|sendmail|exim|dovecot|courier|exchange|smtp|mail"),
    ("cloud", r"cloudtrail|guardduty|azure.*activity|gcp.*audit|kubernetes|docker"),
    ("security", r"suricata|zeek|ossec|fail2ban"),
    ("syslog", r"syslog|systemd|kernel|audit"),
)

# Category, attack type, weight, patterns (case-insensitive but for those in (?-i:...))
CATEGORY_ATTACKS = (
    ("webserver", "sql_injection", 0.9, (r"""('|"|%27|%22)\s*(OR|AND)\s*('|"|%27|%22)\s*\d*\s*=\s*('|"|%27|%22)\s*\d*""", r"(\bUNION\b.*\bSELECT\b|\bSELECT\b.*\bFROM\b)", r";\s*(DROP|DELETE|INSERT|UPDATE|EXEC|EXECUTE)\s+", r"(\bWAITFOR\b|\bDELAY\b|\bSLEEP\b|\bBENCHMARK\b)", r"(INFORMATION_SCHEMA|sys\.(tables|columns|objects)|pg_catalog)")),
    ("webserver", "xss_attack", 0.85, (r"<script[^>]*>.*?</script>", r"javascript:", r"""on\w+\s*=\s*['"]*[^'">\s]+""", r"""<iframe[^>]*src\s*=\s*['"]*javascript:""", r"<svg[^>]*onload\s*=", r"(document\.(cookie|location|write)|window\.location)", r"eval\s*\(|setTimeout\s*\(|setInterval\s*\(")),
    ("webserver", "command_injection", 0.9, (r"[;|`]\s*(cat|ls|pwd|whoami|id|uname|wget|curl|nc|bash|sh|python|perl)\s", r"\$\([^)]*\)|`[^`]*`|\$\{[^}]*\}", r"(chmod|chown|rm\s+-rf|mkdir|rmdir)\s+", r"(/bin/sh|/bin/bash|/bin/python|cmd\.exe|powershell)")),
    ("webserver", "path_traversal", 0.8, (r"\.\.(\/|\\|%2f|%5c|%252f|%255c)", r"(%2e%2e|%252e%252e)", r"(/etc/passwd|/etc/shadow|/etc/hosts|/proc/self)", r"(c:\\windows|c:\\boot\.ini|c:\\system32|c:\\inetpub)")),
    ("webserver", "ssrf_attack", 0.85, (r"(169\.254\.169\.254|metadata\.google\.internal|169-254-169-254)", r"\?.*(url|uri|path|dest|redirect|next)\s*=\s*https?:", r"(file://|gopher://|dict://|ftp://|ldap://)", r"(127\.0\.0\.1|localhost|0\.0\.0\.0|\[::\]|0x7f\.)")),
    ("webserver", "xxe_attack", 0.85, (r"""<!ENTITY\s+[^>]+\s+SYSTEM\s+["'][^"']+["']""", r"<!DOCTYPE\s+[^>]+\s+\[\s*<!ENTITY", r"(file://|expect://|php://filter|http://)")),
    ("webserver", "log4shell", 0.98, (r"\$\{jndi:(ldap|ldaps|rmi|dns|iiop)://", r"\$\{\$\{[^}]*:-[^}]*\}", r"\$\{\s*lower\s*:\s*j\s*\}\s*\{\s*lower\s*:\s*n")),
    ("webserver", "deserialization", 0.9, (r"(rO0|ysoserial|gadgetchain)", r"(?-i:\xac\xed\x00\x05|H4sIAAAAAAAA)")),
    ("webserver", "webshell", 0.85, (r"(c99|r57|b374k|wso|weevely|alfa|p0wny|mini.*shell)", r"\.(php|asp|aspx|jsp)\?cmd=|\?exec=|\?shell=", r"eval\s*\(\s*\$_(GET|POST)|system\s*\(\s*\$|passthru\s*\(\s*\$")),
    ("webserver", "bruteforce", 0.6, (r"(401|403)\s+.*/login|Failed\s+password|Authentication\s+failure",)),
    ("webserver", "reconnaissance", 0.7, (r"(/\.env|/config\.json|/\.git/|/\.htaccess|/phpinfo)", r"(nikto|sqlmap|nmap|masscan|zgrab|nuclei|dirbuster|gobuster)")),
    ("authentication", "bruteforce", 0.75, (r"Failed\s+password|Authentication\s+failure|Invalid\s+user|Failed\s+login",)),
    ("authentication", "password_spray", 0.65, (r"(Authentication\s+failure|Invalid\s+user|Unknown\s+user)",)),
    ("authentication", "credential_stuffing", 0.7, (r"(Account\s+locked|Too\s+many\s+attempts|Rate\s+limit)",)),
    ("authentication", "privilege_escalation", 0.8, (r"(sudo|su\s+-|sudo\s+-i|sudo\s+su|sudo\s+.*ALL)", r"(SetUser|Privilege\s+escalation|Admin\s+access)", r"(useradd|usermod|passwd\s+root)")),
    ("authentication", "lateral_movement", 0.75, (r"(psexec|wmiexec|smbexec|pass\s+the\s+hash)", r"(ssh.*from.*to|scp\s+.*\s+\S+@\S+:\s*)")),
    ("authentication", "account_takeover", 0.75, (r"(impossible\s+travel|unusual\s+location|new\s+device)", r"(suspicious\s+login|account.*compromised)")),
    ("authentication", "kerberoasting", 0.8, (r"(4768.*0x12|4769.*0x17)", r"(krbtgt|ticket_granting|AS-REQ|TGS-REQ)")),
    ("authentication", "pass_the_hash", 0.8, (r"(NTLM.*hash|pass.the.hash|mimikatz|rubeus)",)),
    ("firewall", "port_scan", 0.75, (r"(Connection\s+(refused|timed\s+out)|No\s+route\s+to\s+host)", r"(SYN\s+scan|PORT\s+scan|nmap|masscan)", r"multiple\s+ports?\s+scanned")),
    ("firewall", "ddos", 0.8, (r"(Connection\s+reset\s+by\s+peer|Too\s+many\s+connections)", r"(flood|rate\s+limit\s+exceeded|syn\s+flood)")),
    ("firewall", "reconnaissance", 0.65, (r"(scan|probe|enumerate|discover)",)),
    ("firewall", "c2_communication", 0.7, (r"(beacon|heartbeat|check-in|command.*control)", r"dns\s+tunnel|dga|domain\s+generation")),
    ("firewall", "data_exfiltration", 0.7, (r"(large\s+data\s+transfer|bulk\s+upload|unusual\s+outbound)",)),
    ("firewall", "lateral_movement", 0.7, (r"(internal\s+to\s+internal|east-west\s+traffic)",)),
    ("database", "sql_injection", 0.95, (r"(\bUNION\b.*\bSELECT\b|\bSELECT\b.*\bFROM\b)", r";\s*(DROP|DELETE|INSERT|UPDATE|EXEC|EXECUTE)\s+", r"(INFORMATION_SCHEMA|sys\.(tables|columns|objects)|pg_catalog)", r"(\bWAITFOR\b|\bDELAY\b|\bBENCHMARK\b|\bSLEEP\b)")),
    ("database", "data_exfiltration", 0.8, (r"(SELECT\s+.*\s+INTO\s+OUTFILE|COPY\s+.*\s+TO\s+)", r"(bulk\s+select|bcp\s+.*\s+out)")),
    ("database", "privilege_escalation", 0.75, (r"(GRANT\s+ALL|ALTER\s+USER.*WITH\s+ADMIN)", r"(CREATE\s+USER|ADD\s+MEMBER\s+TO\s+ROLE)")),
    ("database", "insider_threat", 0.7, (r"(unauthorized.*access|sensitive.*table|customer.*data)",)),
    ("mail", "bruteforce", 0.7, (r"(authentication\s+failed|login\s+failed|535|530)",)),
    ("mail", "data_exfiltration", 0.65, (r"(large\s+attachment|bulk\s+email|mass\s+mailing)",)),
    ("mail", "c2_communication", 0.75, (r"(suspicious\s+attachment|executable.*email|macro)",)),
    ("mail", "reconnaissance", 0.6, (r"(user\s+enumeration|verify\s+email|rcpt\s+to.*multiple)",)),
    ("syslog", "privilege_escalation", 0.8, (r"(sudo|su\s+-|sudo\s+-i|sudo\s+su)", r"(chmod\s+.*\+s|setuid|setgid)")),
    ("syslog", "malware_activity", 0.85, (r"(virus|trojan|malware|ransomware|backdoor)", r"(suspicious\s+process|unusual\s+execution)")),
    ("syslog", "cryptomining", 0.9, (r"(xmrig|minerd|cryptonight|stratum\+tcp)", r"(high\s*cpu\s*usage|mining\s*pool)")),
    ("syslog", "ransomware", 0.95, (r"(vssadmin.*delete.*shadows|wmic.*shadowcopy.*delete)", r"(bcdedit.*recoveryenabled.*no)", r"\.(encrypted|locked|crypto|crypt|enc)\b")),
    ("cloud", "privilege_escalation", 0.8, (r"(AssumeRole|CreateAccessKey|AttachUserPolicy)", r"(elevate|escalate|admin.*policy)")),
    ("cloud", "data_exfiltration", 0.75, (r"(GetObject.*large|Download\s+data|ExportSnapshot)", r"(unusual\s+data\s+access|bulk\s+download)")),
    ("cloud", "account_takeover", 0.8, (r"(ConsoleLogin.*suspicious|unusual\s+API\s+calls)", r"(impossible\s+travel|unrecognized\s+principal)")),
    ("cloud", "lateral_movement", 0.75, (r"(cross-account|role.*chaining|AssumeRole.*external)",)),
    ("cloud", "reconnaissance", 0.7, (r"(ListBuckets|DescribeInstances|ListUsers.*rapid)",)),
    ("cloud", "supply_chain", 0.8, (r"(PutBucketPolicy|ModifyLambda|UpdateFunctionCode)",)),
    ("security", "malware_activity", 0.9, (r"(malware.*detected|virus.*found|trojan)",)),
    ("security", "c2_communication", 0.85, (r"(c2.*detected|command.*control|beacon)",)),
    ("security", "port_scan", 0.8, (r"(port\s+scan.*detected|scan\s+alert|reconnaissance)",)),
    ("security", "bruteforce", 0.8, (r"(brute\s+force.*detected|login\s+attack)",)),
    ("generic", "bruteforce", 0.5, (r"(Failed\s+password|Authentication\s+failure)",)),
    ("generic", "malware_activity", 0.7, (r"(virus|trojan|malware)",)),
)

# Classes in order, patterns (case-insensitive)
ORDERED_CLASSES = (
    ("sql_injection", (r"union\s+select", r"'\s+or\s+'1'='1", r"'\s+or\s+1=1", r"drop\s+table", r"exec\s*\(", r"xp_cmdshell", r"0x41414141")),
    ("xss_attack", (r"<script>", r"javascript:", r"onerror=", r"onload=", r"document\.cookie")),
    ("command_injection", (r";\s*(cat|ls|wget|curl|nc|bash|sh)\s", r"\|\s*(cat|ls|wget|curl|nc|bash|sh)\s", r"`.*`", r"\$\(.*\)", r"chmod\s+\d{3,4}")),
    ("path_traversal", (r"\.\./", r"\.\.\\", r"%2e%2e", r"etc/passwd", r"win.ini")),
    ("webshell", (r"\.(php|asp|aspx|jsp)\?cmd=", r"c99|r57|b374k|wso", r"eval\s*\(", r"base64_decode")),
    ("ransomware", (r"vssadmin.*delete", r"shadowcopy.*delete", r"\.locked", r"bcditedit.*recoverydisabled", r"encrypt.*files")),
    ("bruteforce", (r"failed\s+password", r"authentication\s+failure", r"invalid\s+user")),
    ("password_spray", (r"authentication\s+failure", r"unknown\s+user")),
)

# Attack type, tactic ids, technique ids
MITRE_IDS = (
    ("sql_injection", "TA0006", "T1190"),
    ("xss_attack", "TA0006", "T1189"),
    ("command_injection", "TA0002", "T1059"),
    ("path_traversal", "TA0006", "T1083"),
    ("ssrf_attack", "TA0001", "T1190"),
    ("xxe_attack", "TA0001", "T1059"),
    ("ldap_injection", "TA0006", "T1213"),
    ("deserialization", "TA0001", "T1059"),
    ("log4shell", "TA0001", "T1190,T1059"),
    ("prototype_pollution", "TA0001", "T1059"),
    ("file_inclusion", "TA0001", "T1190"),
    ("webshell", "TA0003", "T1505.003"),
    ("bruteforce", "TA0006", "T1110"),
    ("password_spray", "TA0006", "T1110.003"),
    ("credential_stuffing", "TA0006", "T1110.004"),
    ("privilege_escalation", "TA0004", "T1078"),
    ("lateral_movement", "TA0008", "T1021"),
    ("account_takeover", "TA0006", "T1098"),
    ("kerberoasting", "TA0006", "T1558.003"),
    ("pass_the_hash", "TA0008", "T1550.002"),
    ("port_scan", "TA0043", "T1595.001"),
    ("ddos", "TA0040", "T1498"),
    ("reconnaissance", "TA0043", "T1595"),
    ("c2_communication", "TA0011", "T1071"),
    ("data_exfiltration", "TA0010", "T1041"),
    ("malware_activity", "TA0002", "T1204"),
    ("cryptomining", "TA0004", "T1496"),
    ("ransomware", "TA0040", "T1486"),
    ("insider_threat", "TA0004", "T1078"),
    ("supply_chain", "TA0001", "T1195"),
    ("dns_tunneling", "TA0010", "T1071.004"),
)

# Attack type, tactics and techniques of the desktop form; others have the defaults
DESKTOP_TACTICS = (
    ("bruteforce", ("TA0006 - Credential Access", "TA0001 - Initial Access"), "T1110 - Brute Force"),
    ("password_spray", ("TA0006 - Credential Access", "TA0001 - Initial Access"), "T1110 - Brute Force"),
    ("sql_injection", ("TA0006 - Credential Access", "TA0002 - Execution"), "T1190 - Exploit Public-Facing Application"),
    ("xss_attack", ("TA0006 - Credential Access", "TA0002 - Execution"), "T1190 - Exploit Public-Facing Application"),
    ("command_injection", ("TA0001 - Initial Access", "TA0002 - Execution"), "T1059 - Command and Scripting Interpreter"),
    ("path_traversal", ("TA0006 - Credential Access", "TA0007 - Discovery"), "T1083 - File and Directory Discovery"),
    ("file_inclusion", ("TA0006 - Credential Access", "TA0002 - Execution"), "T1190 - Exploit Public-Facing Application"),
    ("privilege_escalation", ("TA0004 - Privilege Escalation",), "T1068 - Exploitation for Privilege Escalation"),
    ("lateral_movement", ("TA0008 - Lateral Movement",), "T1021 - Remote Services"),
    ("data_exfiltration", ("TA0010 - Exfiltration",), "T1041 - Exfiltration Over C2"),
    ("ransomware", ("TA0040 - Impact",), "T1486 - Data Encrypted for Impact"),
    ("webshell", ("TA0003 - Persistence", "TA0002 - Execution"), "T1505 - Server Software Component"),
    ("c2_communication", ("TA0011 - Command and Control",), "T1071 - Application Layer Protocol"),
    ("account_takeover", ("TA0006 - Credential Access", "TA0001 - Initial Access"), "T1078 - Valid Accounts"),
    ("mfa_bypass", ("TA0006 - Credential Access",), "T1556 - Modify Authentication Process"),
    ("mfa_fatigue", ("TA0006 - Credential Access",), "T1556 - Modify Authentication Process"),
    ("session_hijacking", ("TA0006 - Credential Access",), "T1550 - Steal Application Access Token"),
    ("credential_stuffing", ("TA0006 - Credential Access",), "T1110 - Brute Force"),
    ("malware_activity", ("TA0002 - Execution", "TA0003 - Persistence"), "T1204 - User Execution"),
    ("insider_threat", ("TA0003 - Persistence", "TA0010 - Exfiltration"), "TA0003 - Persistence"),
    ("reconnaissance", ("TA0043 - Reconnaissance",), "T1595 - Gather Victim Host Information"),
    ("port_scan", ("TA0043 - Reconnaissance",), "T1046 - Network Service Discovery"),
    ("ddos", ("TA0040 - Impact",), "T1498 - Network Denial of Service"),
)
# Attack type, tactics and technique of the web form; what it lacks is Unknown
WEB_TACTICS = (
    ("bruteforce", ("TA0006 - Credential Access",), "T1110.001 - Password Guessing"),
    ("password_spray", ("TA0006 - Credential Access",), "T1110.003 - Password Spraying"),
    ("credential_stuffing", ("TA0006 - Credential Access",), "T1110.004 - Credential Stuffing"),
    ("mfa_bypass", ("TA0006 - Credential Access", "TA0005 - Defense Evasion"), "Unknown"),
    ("mfa_fatigue", ("TA0006 - Credential Access",), "Unknown"),
    ("session_hijacking", ("TA0006 - Credential Access", "TA0008 - Lateral Movement"), "Unknown"),
    ("account_takeover", ("TA0006 - Credential Access", "TA0001 - Initial Access"), "Unknown"),
    ("sql_injection", ("TA0001 - Initial Access", "TA0009 - Collection"), "T1190 - Exploit Public-Facing Application"),
    ("xss_attack", ("TA0001 - Initial Access", "TA0009 - Collection"), "T1189 - Drive-by Compromise"),
    ("path_traversal", ("TA0001 - Initial Access", "TA0009 - Collection"), "T1083 - File and Directory Discovery"),
    ("command_injection", ("TA0002 - Execution",), "T1059 - Command and Scripting Interpreter"),
    ("privilege_escalation", ("TA0004 - Privilege Escalation",), "T1068 - Exploitation for Privilege Escalation"),
    ("lateral_movement", ("TA0008 - Lateral Movement",), "T1021 - Remote Services"),
    ("data_exfiltration", ("TA0010 - Exfiltration",), "T1041 - Exfiltration Over C2 Channel"),
    ("port_scan", ("TA0043 - Reconnaissance",), "T1046 - Network Service Discovery"),
    ("ddos", ("TA0040 - Impact",), "T1498 - Network Denial of Service"),
    ("reconnaissance", ("TA0043 - Reconnaissance",), "T1595 - Active Scanning"),
    ("malware_activity", ("TA0002 - Execution", "TA0003 - Persistence"), "T1204 - User Execution"),
    ("c2_communication", ("TA0011 - Command and Control",), "T1071 - Application Layer Protocol"),
    ("insider_threat", ("TA0009 - Collection", "TA0010 - Exfiltration"), "Unknown"),
    ("log4shell", ("TA0001 - Initial Access", "TA0002 - Execution"), "T1190 - Exploit Public-Facing Application"),
    ("ransomware", ("TA0040 - Impact", "TA0002 - Execution"), "T1486 - Data Encrypted for Impact"),
    ("anomaly", ("TA0043 - Reconnaissance",), "Unknown"),
)
# Attack type and the tactics of a chain that has it
CHAIN_TACTICS = (
    ("bruteforce", ("Credential Access",)),
    ("credential_stuffing", ("Credential Access",)),
    ("sql_injection", ("Initial Access", "Execution")),
    ("xss_attack", ("Initial Access",)),
    ("path_traversal", ("Initial Access", "Exfiltration")),
    ("threat_intel", ("Reconnaissance",)),
    ("anomaly", ("Suspicious Activity",)),
    ("spam_activity", ("Resource Hijacking",)),
    ("account_takeover", ("Persistence", "Privilege Escalation")),
)
