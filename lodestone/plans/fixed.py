"""Word lists, category tables and constants that results depend on."""

from __future__ import annotations

# Extensions by category. An extension in two lists belongs to the later one.
EXTENSIONS: dict[str, tuple[str, ...]] = {
    "ThreeDimensionalModel": (".blend", ".fbx", ".obj", ".stl", ".3mf", ".gltf", ".glb", ".dae", ".3ds", ".max", ".ma", ".mb", ".c4d", ".lwo", ".ply", ".x3d", ".usd", ".usda", ".usdc", ".usdz", ".abc", ".sldprt", ".sldasm"),
    "CadDrawing": (".dwg", ".dxf", ".step", ".stp", ".iges", ".igs", ".ifc", ".skp", ".ipt", ".iam", ".catpart", ".catproduct"),
    "Image": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tif", ".tiff", ".heic", ".svg", ".psd", ".ai", ".xcf", ".raw", ".cr2", ".nef"),
    "Video": (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".webm", ".m4v", ".mts"),
    "Audio": (".mp3", ".wav", ".flac", ".m4a", ".aac", ".ogg", ".wma", ".opus"),
    "Document": (".pdf", ".doc", ".docx", ".hwp", ".hwpx", ".txt", ".md", ".rtf", ".odt", ".log", ".epub"),
    "Spreadsheet": (".xls", ".xlsx", ".xlsm", ".xlsb", ".xltx", ".xltm", ".csv", ".ods"),
    "Presentation": (".ppt", ".pptx", ".odp"),
    "Archive": (".zip", ".7z", ".rar", ".tar", ".gz", ".bz2", ".xz"),
    "SourceCode": (".cs", ".xaml", ".js", ".ts", ".tsx", ".jsx", ".py", ".java", ".cpp", ".c", ".h", ".hpp", ".go", ".rs", ".php", ".html", ".css", ".scss", ".json", ".xml", ".yaml", ".yml", ".ps1", ".bat", ".cmd", ".sh", ".sql"),
    "Executable": (".exe", ".msi", ".msix", ".appx", ".com", ".scr"),
    "Font": (".ttf", ".otf", ".woff", ".woff2"),
    "Database": (".db", ".sqlite", ".sqlite3", ".mdb", ".accdb"),
    "DiskImage": (".iso", ".img", ".vhd", ".vhdx", ".vmdk"),
}

# Words of a query that name a category.
CATEGORY_WORDS: dict[str, tuple[str, ...]] = {
    "ThreeDimensionalModel": ("3d", "3차원", "모델링", "메시", "mesh", "블렌더", "blender", "마야", "maya", "스컬프팅", "sculpt", "렌더링", "rendering"),
    "CadDrawing": ("cad", "캐드", "도면", "설계도", "기계설계", "건축설계"),
    "Image": ("사진", "이미지", "그림", "스크린샷", "캡처", "photo", "image", "picture"),
    "Video": ("영상", "동영상", "비디오", "녹화", "movie", "video"),
    "Audio": ("음악", "음원", "오디오", "녹음", "소리", "music", "audio", "sound"),
    "Document": ("문서", "보고서", "텍스트", "글", "document", "report"),
    "Spreadsheet": ("엑셀", "스프레드시트", "표", "excel", "spreadsheet"),
    "Presentation": ("파워포인트", "프레젠테이션", "발표자료", "ppt", "powerpoint", "presentation"),
    "Archive": ("압축", "압축파일", "아카이브", "zip", "archive"),
    "SourceCode": ("소스", "소스코드", "소스 코드", "프로그래밍", "개발코드", "스크립트", "source code", "sourcecode", "script"),
    "Executable": ("프로그램", "실행파일", "설치파일", "앱", "application", "executable", "installer"),
    "Font": ("폰트", "글꼴", "font"),
    "Database": ("데이터베이스", "디비", "database"),
    "DiskImage": ("디스크이미지", "디스크 이미지", "가상이미지", "iso"),
}

# Words that say nothing about what is wanted.
STOP_WORDS = frozenset(
    (
        "관련", "관련된", "자료", "파일", "폴더", "찾기", "찾아", "찾아줘", "찾아줘요", "찾아주라", "찾아달라", "찾아주세요",
        "보여줘", "보여줘요", "보여달라", "보여주세요", "대한", "있는", "내", "좀", "해줘", "검색", "검색해줘", "검색해줘요", "검색해달라", "검색해주세요",
        "담긴", "담겨", "들어간", "들어있는", "포함된", "포함", "내용", "쓰는", "쓰이는", "사용하는", "사용되는", "사용하", "사용되",
        "사용한", "필요한", "있는지", "어디", "어딘가", "혹시", "오늘", "어제", "지난달", "저번달", "이번달", "지난주", "이번주",
        "작년", "올해", "최근", "최신", "새로", "수정", "수정한", "찾고", "만든", "만들어진", "생성", "생성한", "생성된", "작성",
        "작성한", "작성된", "업데이트", "업데이트한", "변경", "편집", "더", "조금", "많이", "강하게", "약하게", "가장", "무조건",
        "우선", "우선해", "우선하고", "먼저", "위", "위로", "아래", "아래로", "오게", "오도록", "높게", "낮게", "중요", "중요하게",
        "올려", "올려줘", "올리고", "내려", "내려줘", "내리고", "가중치", "비중", "정렬", "순", "순서", "기준", "일수록",
    )
)

# Words of one character that mean something.
SHORT_WORDS = frozenset(("키", "값", "표", "글", "앱", "웹", "책", "차", "집", "돈"))

# Words that steer ranking.
RANKING_WORDS = frozenset(
    (
        "파일명", "제목", "정확", "정확한", "정확도", "일치", "일치도", "경로", "폴더명", "위치", "확장자", "형식", "종류", "본문",
        "의미", "유사", "유사도", "크기", "큰", "작은", "대용량", "소용량", "생성일", "작성일", "수정일", "최신순", "최근순",
    )
)

# Endings of words, in the order they are tried.
ENDINGS = ("일수록", "에서는", "으로는", "에게서", "에서", "으로", "에게", "까지", "부터", "처럼", "보다", "하고", "이며", "과", "와", "을", "를", "이", "가", "은", "는", "의", "에", "로")

# Patterns of what a query asks for. Results depend on their exact wording.
FLOOR = r"(?:지하[\s._-]*0*(?P<basement>\d{1,3})[\s._-]*층|(?<![a-z0-9])b[\s._-]*0*(?P<english>\d{1,3})[\s._-]*(?:f|층)?(?![a-z0-9])|(?<![^\W_])0*(?P<ground>\d{1,3})[\s._-]*층)"
EXTENSION = r"(?<![^\W_])(?:\*)?\.(?P<extension>[a-z0-9][a-z0-9_+-]{0,31})(?![\w._+-])"
ILLUSTRATOR = r"일러스트레이터|adobe\s*illustrator"
FOLDERS = r"폴더\s*(을|를)?\s*(찾|보여|검색)"
PERCENT = r"(?P<percent>\d{1,3})\s*%"
HALF_LIFE = r"(?P<amount>\d{1,4})\s*(?P<unit>일|주|개월|달|년)"
RANKING_CUE = r"우선|먼저|위로|아래로|정렬|순(?:으로)?|중요|가중치|비중|높게|낮게|일수록"
DOMINANT = r"무조건|최우선|가장\s*중요"
STRONG = r"강하게|많이|더\s*중요|더\s*위"
SLIGHT = r"조금|약하게|살짝"
PRIMARY = r"무조건|최우선|가장\s*중요|1\s*순위"
CREATION = r"생성|만들|작성"
MODIFICATION = r"수정|업데이트|변경|편집"
RECENCY = r"최근|최신|새로|오래된|생성일|작성일|수정일"
RECENT = r"최근|최신"
OLDER_FIRST = r"오래된.*(?:우선|먼저|위|순)|(?:오래된|과거).*파일.*위"
RECENCY_PRIMARY = r"무조건.*(?:최근|최신|새로|오래)|(?:최근|최신|생성일|작성일|수정일|오래된)\s*순|최우선"
LOWER_FIRST = r"덜\s*중요|아래|낮게|감점"
LARGE_FILES = r"큰\s*파일|대용량|크기.*큰"
SMALL_FILES = r"작은\s*파일|소용량|크기.*작"
MATCH_WISHES = (
    ("NameMatch", r"파일명|제목|이름.*정확|정확한.*이름"),
    ("PathMatch", r"경로|폴더명|위치"),
    ("TypeMatch", r"확장자|파일\s*형식|파일\s*종류"),
    ("ContentMatch", r"본문|내용"),
    ("SemanticMatch", r"의미|유사|(?<![a-z0-9])ai(?![a-z0-9])"),
)
MODES = (
    ("Visual", r"이미지|사진|그림|스크린샷|image|photo|picture"),
    ("Application", r"설치|프로그램|응용\s*프로그램|앱|실행|바로가기|아이콘|launcher|application|shortcut"),
    ("ExactName", r"파일명|폴더명|제목|이름\s*(?:이|가|은|는)?\s*(?:정확히|같|일치|포함)|이라는\s*이름|따옴표"),
    ("ContentContains", r"본문|내용\s*(?:에|에서)|담긴|담겨|들어간|들어\s*있는|포함된|포함하는"),
    ("TopicRelated", r"관련|관한|대한|연관|자료|정보|문서"),
)
PREVIOUS = r"(?:그\s*중|그\s*결과|검색\s*결과|결과\s*(?:안|내|중|에서)|방금\s*(?:찾은|검색한)|여기서|거기서)"

# Patterns of clauses about scripts, after the scope and before it, and of what goes with them.
SCRIPT_CLAUSE = r"(?:(?P<scope>파일\s*명|파일\s*이름|이름|제목|본문|내용|문서\s*(?:안|속)|경로|폴더\s*명)\s*(?:에|에는|에서|이|가|은|는|중에|중에서)?\s*)?(?:(?P<exclusive>전부|오직)\s*)?(?P<script>한글|한국어|영문|영어|알파벳|숫자)(?:이|가|를|로)?\s*(?P<only>만(?:으로)?\s*)?(?P<relation>되어\s*있는|들어간|들어있는|포함된|포함한|이루어진|구성된|사용된|사용한|작성된|적힌|쓰인|쓴|포함|있는|없는|없음|제외한|제외|된)"
SCRIPT_CLAUSE_REVERSED = r"(?:(?P<exclusive>전부|오직)\s*)?(?P<script>한글|한국어|영문|영어|알파벳|숫자)(?:이|가|를|로)?\s*(?P<only>만(?:으로)?\s*)?(?P<relation>되어\s*있는|포함된|이루어진|구성된|사용된|사용한|작성된|적힌|쓰인|쓴|있는|없는|된)\s*(?P<scope>파일\s*명|파일\s*이름|이름|제목|본문|내용|경로|폴더\s*명)"
FILES_ONLY = r"파일(?:들)?\s*만"
FILE_NAME_SCOPE = r"파일\s*(?:명|이름)"
FILES_TARGET = r"(?<![^\W_])파일(?!\s*(?:명|이름))(?:들)?(?:만|을|를|이|가|은|는)?(?![^\W_])"
HWP_FORMAT = r"(?<![^\W_])한글\s*(?:파일|문서)(?:만|을|를|이|가|은|는)?(?![^\W_])"
SCRIPTS = {"한글": "Hangul", "한국어": "Hangul", "영문": "Latin", "영어": "Latin", "알파벳": "Latin", "숫자": "Digit"}

# Latin readings of a syllable's initial, vowel and final.
INITIALS = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
VOWELS = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
FINALS = ("", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "h")
# How a loanword's reading goes on: each step changes the reading before it.
LOAN_STEPS = (
    (("eu", "u"), ("eo", "o"), ("ae", "e"), ("ui", "i")),
    (("p", "f"), ("j", "z"), ("r", "l"), ("b", "v")),
    (("ai", "i"), ("oi", "i")),
)
# Letters that sound alike.
SOUNDS = {"F": "bpfv", "K": "cgkq", "T": "dt", "Z": "jz", "L": "lr", "S": "sx", "M": "m", "N": "n", "H": "h", "W": "w"}

# Groups of words with one meaning, for names and paths.
NAME_GROUPS: tuple[tuple[str, ...], ...] = (
    ("와이파이", "wifi", "wi-fi", "무선", "wlan"),
    ("네트워크", "network", "랜", "lan"),
    ("오류", "에러", "error", "장애", "고장", "문제", "끊김", "실패", "fail", "crash"),
    ("백업", "backup", "복사본"),
    ("보고서", "리포트", "report"),
    ("회의", "미팅", "meeting", "회의록"),
    ("계약", "계약서", "contract"),
    ("영수증", "receipt"),
    ("청구서", "invoice"),
    ("로그인", "로그온", "login", "logon", "signin", "sign-in", "인증", "접속", "계정", "계정정보", "account", "credential", "credentials", "자격정보", "username", "사용자명", "아이디", "key", "privatekey", "ppk", "pem"),
    ("코드", "code", "인증코드", "인증번호", "접속코드", "accesscode"),
    ("비밀번호", "password", "패스워드", "암호"),
    ("키", "ssh", "ssh키", "sshkey", "ssh-key", "ssh key", "개인키", "비밀키", "공개키", "키파일", "키 파일", "키페어", "키 페어", "키쌍", "privatekey", "private-key", "private key", "publickey", "public-key", "public key", "keypair", "key pair", "key", "putty", "rsa", "ed25519", "ppk", "pem", "pub", "id_rsa", "id_ed25519", "credential", "credentials", "자격증명", "접속자격", "계정", "인증"),
    ("vpn", "가상사설망"),
)

# The narrower groups for the text inside documents, beyond the first nine of NAME_GROUPS.
TEXT_GROUPS: tuple[tuple[str, ...], ...] = (
    *NAME_GROUPS[:9],
    ("ai", "인공지능", "stable diffusion", "stablediffusion", "comfyui", "txt2img", "img2img", "생성형ai", "negative prompt", "cfg scale", "sampler", "seed", "lora", "model hash", "workflow"),
    ("태그", "tag", "tags", "prompt", "negative prompt", "cfg scale", "sampler", "seed", "lora", "model hash", "workflow", "score_9", "1girl", "1boy"),
    ("로그인", "로그온", "login", "logon", "signin", "sign-in"),
    ("계정", "계정정보", "account", "credential", "credentials", "자격정보", "username", "사용자명", "아이디"),
    ("인증", "authentication", "authenticate"),
    ("접속", "connection", "connect"),
    ("코드", "code", "인증코드", "인증번호", "접속코드", "accesscode"),
    ("비밀번호", "password", "패스워드", "암호"),
    ("vpn", "가상사설망"),
)

# What an extension's format is for.
CONCEPTS: dict[str, tuple[str, ...]] = {
    ".ppk": ("PuTTY SSH 개인키", "SSH private key", "서버 접속 키", "계정 인증 자격 증명"),
    ".pem": ("PEM 인증서 또는 개인키", "certificate private key", "TLS SSH 서버 인증 자격 증명"),
    ".key": ("개인키 또는 암호화 키", "private secret encryption key", "서버 인증 자격 증명"),
    ".pub": ("SSH 공개키", "public key", "서버 접속 인증 키"),
    ".crt": ("디지털 인증서", "TLS SSL certificate"),
    ".cer": ("디지털 인증서", "TLS SSL certificate"),
    ".der": ("DER 디지털 인증서", "binary certificate"),
    ".pfx": ("PKCS12 인증서와 개인키", "certificate private key bundle"),
    ".p12": ("PKCS12 인증서와 개인키", "certificate private key bundle"),
    ".csr": ("인증서 서명 요청", "certificate signing request"),
    ".jks": ("Java 키 저장소", "Java key store certificate"),
    ".keystore": ("키 저장소", "key store certificate"),
    ".kubeconfig": ("Kubernetes 접속 설정", "cluster account credential configuration"),
    ".ovpn": ("OpenVPN 접속 설정", "VPN account credential configuration"),
    ".rdp": ("원격 데스크톱 접속 설정", "remote desktop connection"),
    ".env": ("환경 변수 설정", "application configuration secrets"),
    ".ini": ("프로그램 설정", "configuration"),
    ".conf": ("프로그램 서버 설정", "configuration"),
    ".config": ("프로그램 설정", "configuration"),
    ".toml": ("프로그램 설정", "configuration"),
    ".properties": ("프로그램 설정", "configuration"),
}

# Evidence kinds with their guardrail and priority. A visual candidate counts for more in a visual query.
GUARDRAILS = {"ExactName": 3, "Combined": 2}
PRIORITIES = {"ExactName": 800, "Combined": 760, "NameCandidate": 700, "Content": 620, "Path": 540, "SemanticCandidate": 450, "VisualCandidate": 320}
VISUAL_GUARDRAIL, VISUAL_PRIORITY, OTHER_PRIORITY = 2, 740, 100

# Names of categories, and how a file's type is shown where it isn't the name.
CATEGORY_LABELS = {
    "ThreeDimensionalModel": "3D 모델",
    "CadDrawing": "CAD 도면",
    "Image": "이미지",
    "Video": "동영상",
    "Audio": "오디오",
    "Document": "문서",
    "Spreadsheet": "스프레드시트",
    "Presentation": "프레젠테이션",
    "Archive": "압축 파일",
    "SourceCode": "소스 코드",
    "Executable": "실행 파일",
    "Font": "글꼴",
    "Database": "데이터베이스",
    "DiskImage": "디스크 이미지",
    "Other": "일반 파일",
}
TYPE_DISPLAYS = {
    "Image": "이미지 파일",
    "Video": "비디오 파일",
    "Audio": "오디오 파일",
    "Spreadsheet": "스프레드시트",
    "Presentation": "프레젠테이션",
    "Archive": "압축 파일",
    "SourceCode": "소스 코드",
    "Executable": "응용 프로그램",
    "Font": "글꼴 파일",
    "Database": "데이터베이스 파일",
    "DiskImage": "디스크 이미지",
    "Document": "문서",
}
EXTENSION_DISPLAYS = {
    ".xlsx": "Excel 통합 문서",
    ".pptx": "PowerPoint 프레젠테이션",
    ".pdf": "PDF 문서",
    ".doc": "Word 문서",
    ".docx": "Word 문서",
    ".hwp": "한글 문서",
    ".hwpx": "한글 표준 문서",
    ".txt": "텍스트 문서",
    ".md": "Markdown 문서",
    ".log": "로그 파일",
}
FOLDER_DISPLAY, FILE_DISPLAY = "파일 폴더", "파일"

# Badges of evidence, short and long; {} is the percentage. Advanced analysis has a badge of its own.
BADGES = {"ExactName": "정확 일치", "Application": "앱·바로가기", "Combined": "이름·내용 일치", "NameCandidate": "이름 일치", "Content": "본문 일치", "Path": "경로 단서", "Metadata": "메타데이터 일치", "VisualCandidate": "시각 후보 {}%", "SemanticCandidate": "AI 후보 {}%"}
ADVANCED_BADGE, OTHER_BADGE = "정밀 AI {}%", "검색 일치 {}%"
RELEVANCE = {"ExactName": "파일명 직접 일치", "Application": "Windows 앱 직접 일치", "Combined": "이름·내용 근거", "NameCandidate": "파일명 근거", "Path": "상위 경로 근거", "Content": "본문 근거", "Metadata": "메타데이터 근거"}
RELEVANCE_STEPS = ((90.0, "연관성 매우 높음"), (75.0, "연관성 높음"), (55.0, "연관성 보통"), (0.0, "연관성 낮음"))

# Words of reasons, with the place they take among reasons.
REASON_PRIORITIES = (("파일명", 6), ("본문", 5), ("ocr", 5), ("엑셀", 5), ("경로", 4), ("시각", 3), ("siglip", 3), ("multilingual e5", 2))

# Bonus of an application's source, and of any other.
SOURCE_BONUS = {"공용 바탕 화면": 70, "사용자 바탕 화면": 70, "공용 시작 메뉴": 55, "사용자 시작 메뉴": 55}
OTHER_SOURCE_BONUS = 35

# Folders of a user that come first, below the user's own folder, and that folder's priority.
USER_FOLDERS = (("Desktop", 50), ("Documents", 45), ("Downloads", 45))
USER_FOLDER = 30

# Folders and names of generated images.
GENERATED_FOLDERS = ("ai", "ai images", "ai image", "ai 이미지", "comfyui", "novelai", "automatic1111", "stable diffusion", "stable-diffusion", "stable-diffusion-webui")
GENERATED_PARTS = ("comfyui", "stable-diffusion")
PICTURE_FOLDERS = ("output", "outputs", "generated", "generations", "images", "pictures", "이미지", "사진")

# Extensions of sheets that are read first, and categories of image tags in label files.
SHEETS = (".xls", ".xlsx", ".xlsm", ".xlsb", ".xltx", ".xltm")
TAG_CATEGORIES = {4: "Character", 9: "Rating"}

# Words that say what kind of image is wanted.
CHARACTER_WORDS = ("캐릭터", "인물 일러스트", "팬아트", "팬 아트", "애니", "만화", "character", "fanart", "fan art", "anime", "cartoon")
INTERFACE_WORDS = ("스크린샷", "화면 캡처", "화면캡처", "user interface", "인터페이스", "앱 화면", "프로그램 화면", "대시보드", "dialog", "screenshot")
DOCUMENT_WORDS = ("문서", "영수증", "청구서", "계약서", "신분증", "명함", "pdf", "document", "receipt", "invoice", "scan")
OFFICE_WORDS = (
    "사무 자료", "사무자료", "업무 자료", "업무자료", "회의 자료", "회의자료", "보고서 이미지", "서류", "양식", "스프레드시트",
    "엑셀 화면", "프레젠테이션", "슬라이드", "표가 있는", "그래프", "차트", "도표", "화이트보드", "office document",
    "business document", "spreadsheet", "presentation", "slide", "form", "chart", "whiteboard",
)
GENERIC_WORDS = ("사진", "이미지", "그림", "파일", "자료", "photo", "image", "picture", "file", "캐릭터", "character", "팬아트", "fanart", "anime")
CONCRETE_WORDS = (
    "person", "woman", "man", "family", "baby", "child", "face", "dog", "cat", "bird", "animal", "car", "vehicle", "motorcycle",
    "bicycle", "airplane", "train", "boat", "building", "house", "room", "office", "city", "street", "mountain", "ocean", "beach",
    "river", "lake", "forest", "tree", "flower", "sky", "cloud", "snow", "rain", "sunset", "sunrise", "food", "coffee", "cake",
    "wedding", "meeting", "product", "computer", "phone", "logo", "icon", "map", "chart", "poster", "red", "blue", "green", "yellow",
    "purple", "orange", "black", "white", "adult", "nude", "naked", "erotic", "explicit", "office document", "spreadsheet", "slide",
    "presentation", "form", "whiteboard", "diagram", "flowchart",
)
IMAGE_WORDS = ("scan", "screenshot", "photo", "picture", "image")
QUERY_NOISE = r"(찾아\s*줘|찾아줘|찾아\s*주세요|검색해\s*줘|검색해줘|관련된?|파일들?|자료들?|보여\s*줘|보여줘)"
PARTICLE = r"(^|\s)(을|를|이|가|은|는|의|에|로|와|과)($|\s)"

# Prompts that images are compared with.
INTERFACE_PROMPT = "software user interface screenshot, application window, dashboard, menu, dialog box, document page with interface text"
CHARACTER_PROMPT = "a high quality character portrait or character illustration, centered fictional character"
NO_SUBJECT = "요청한 대상, requested subject"
PROMPTS = {
    "Character": "{}, 캐릭터 일러스트, character illustration, single fictional character",
    "UserInterface": "{}, 프로그램 화면, software user interface screenshot",
    "OfficeMaterial": "{}, 사무 문서 또는 업무 자료, office document, business material, spreadsheet, presentation or diagram",
    "Document": "{}, 문서 페이지, document page or scanned document",
    "General": "{}, 사진 또는 이미지, photo or image",
}
MORE_PROMPTS = {
    "Character": ("{}, 공식 캐릭터 그림, official character artwork", "{}, 애니메이션 또는 게임 캐릭터, anime or game character"),
    "OfficeMaterial": ("{}, 표 차트 문서 슬라이드, table chart document slide", "{}, 스캔 서류 또는 사무실 자료, scanned office material"),
    "General": ("{}, 관련 이미지, image depicting the subject",),
}
# Least similarity, distance from the best, margin over interfaces and lift of a named subject, by kind of image.
VISUAL_LIMITS = {
    "UserInterface": (0.05, 0.10, None, None),
    "NamedCharacter": (0.075, 0.09, 0.015, 0.02),
    "Character": (0.07, 0.09, 0.015, None),
    "OfficeMaterial": (0.05, 0.11, None, None),
    "Document": (0.05, 0.10, None, None),
    "General": (0.055, 0.10, None, None),
}

# What a query's words mean in an image prompt.
VISUAL_WORDS: dict[str, str] = {
    "게임 캐릭터": "video game character", "애니메이션 캐릭터": "anime character", "인물 일러스트": "character portrait illustration", "캐릭터": "fictional character",
    "팬 아트": "fan art", "팬아트": "fan art", "애니메이션": "anime", "애니": "anime", "만화": "cartoon illustration", "일러스트": "illustration",
    "초상화": "portrait", "전신": "full body", "반신": "upper body", "스크린샷": "screenshot", "화면 캡처": "screenshot", "화면캡처": "screenshot",
    "사무 자료": "office business material", "사무자료": "office business material", "업무 자료": "business work material", "업무자료": "business work material",
    "회의 자료": "meeting document or presentation", "회의자료": "meeting document or presentation", "스프레드시트": "spreadsheet", "엑셀 화면": "spreadsheet screen",
    "프레젠테이션": "presentation slide", "슬라이드": "presentation slide", "화이트보드": "office whiteboard notes", "순서도": "flowchart",
    "도표": "business diagram or chart", "양식": "business form", "서류": "office document", "계좌": "bank account", "영수증": "receipt", "청구서": "invoice",
    "계약서": "contract document", "신분증": "identity card", "명함": "business card", "메뉴판": "menu", "바코드": "barcode", "큐알코드": "QR code", "QR코드": "QR code",
    "손글씨": "handwriting", "서명": "signature", "포스터": "poster", "표지": "cover", "문서": "document", "표가 있는": "table", "그래프": "chart graph", "차트": "chart",
    "지도": "map", "도면": "technical drawing", "설계": "design drawing", "로고": "logo", "아이콘": "icon", "증명사진": "portrait photo", "인물": "person portrait",
    "사람": "person", "가족": "family", "아기": "baby", "어린이": "child", "남자": "man", "여자": "woman", "성인물": "adult content", "성인 이미지": "adult image",
    "성인 사진": "adult photo", "누드": "nude", "나체": "nude person", "에로틱": "erotic", "노출": "revealing adult image", "얼굴": "face portrait",
    "강아지": "dog", "고양이": "cat", "새 사진": "bird photo", "조류": "bird", "동물": "animal", "자동차": "car", "차량": "vehicle", "오토바이": "motorcycle",
    "자전거": "bicycle", "비행기": "airplane", "기차": "train", "선박": "boat ship", "보트": "boat", "건물": "building", "주택": "house", "가옥": "house",
    "집 사진": "house photo", "방 사진": "room photo", "실내": "indoor room", "야외": "outdoor", "사무실": "office", "도시": "city", "거리": "street",
    "산 풍경": "mountain landscape", "산 사진": "mountain photo", "산악": "mountain", "바다": "ocean sea", "해변": "beach", "강물": "river", "강 사진": "river photo",
    "호수": "lake", "숲": "forest", "나무": "tree", "꽃": "flower", "하늘": "sky", "구름": "cloud", "설경": "snow landscape", "눈 내린": "snow", "비 오는": "rain",
    "우천": "rain", "노을": "sunset", "일출": "sunrise", "야경": "night city", "봄 풍경": "spring landscape", "여름": "summer", "가을": "autumn", "겨울": "winter",
    "음식": "food", "식사": "meal", "커피": "coffee", "케이크": "cake", "여행": "travel", "휴가": "vacation", "결혼식": "wedding", "생일": "birthday", "회의": "meeting",
    "제품": "product", "기계": "machine", "컴퓨터": "computer", "휴대폰": "smartphone", "모니터": "monitor", "사진": "photo", "이미지": "image", "그림": "illustration",
    "그려진": "illustration", "풍경": "landscape", "흑백": "black and white", "검은색": "black", "흰색": "white", "빨간": "red", "붉은": "red", "빨간색": "red",
    "파란": "blue", "푸른": "blue", "파란색": "blue", "초록": "green", "녹색": "green", "초록색": "green", "노란": "yellow", "노란색": "yellow", "보라": "purple",
    "보라색": "purple", "주황": "orange", "주황색": "orange", "밝은": "bright", "어두운": "dark",
}

#: Category of each extension.
CATEGORIES = {e: c for c, es in EXTENSIONS.items() for e in es}
